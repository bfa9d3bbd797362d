"""Structured Streaming: each micro-batch of update lines is one step of incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deltaweave.functions.kernels import SelectKernel, SumKernel
from deltaweave.operators.fixpoint import Rounds, run_select, run_sum
from deltaweave.operators.incremental import update_select, update_sum
from deltaweave.operators.updates import validate
from deltaweave.session import cut, exists, list_path, remove_path
from deltaweave.sources.graph import Graph


def update_stream(spark: SparkSession, path: str, weight_type: str = "long") -> DataFrame:
    """A stream of (op, src, dst, weight) from text files that arrive in ``path``."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.readStream.text(path).where("value <> '' and value not like '#%'")
    return lines.select(F.get(f, F.lit(0)).alias("op"), F.get(f, F.lit(1)).cast("long").alias("src"), F.get(f, F.lit(2)).cast("long").alias("dst"), F.get(f, F.lit(3)).cast(weight_type).alias("weight"))


class MaintainedResult:
    """A graph and one query's result, kept up to date batch by batch.

    With a ``folder`` in shared storage the graph's edges and the result are written after each batch,
    under its number; a new object on the same folder goes on from the last batch that was written whole,
    whatever graph it is given. A batch that was already applied (a replay after a restart) is skipped.
    """

    def __init__(self, g: Graph, kernel: SumKernel | SelectKernel, source: int | None = None, how: Rounds | None = None, folder: str | None = None) -> None:
        self.kernel, self.source, self.how, self.graph, self.last, self.folder = kernel, source, how or Rounds(), g, -1, folder.rstrip("/") if folder else None
        spark = g.vertices.sparkSession
        done = [int(n) for n in list_path(spark, self.folder) if exists(spark, f"{self.folder}/{n}/state/_SUCCESS")] if self.folder else []
        if done:
            self._load(max(done))
        else:
            self.state = run_sum(g, kernel, self.how) if isinstance(kernel, SumKernel) else run_select(g, kernel, source)

    def _load(self, batch: int) -> None:
        spark, path = self.graph.vertices.sparkSession, f"{self.folder}/{batch}"
        self.graph = Graph(self.graph.vertices, spark.read.parquet(f"{path}/edges"), self.graph.directed)
        self.state, self.last = spark.read.parquet(f"{path}/state"), batch

    def apply(self, updates: DataFrame, batch: int | None = None) -> None:
        if batch is not None and batch <= self.last:
            return
        updates = cut(updates)
        validate(self.graph, updates)
        if isinstance(self.kernel, SumKernel):
            g, self.state = update_sum(self.graph, self.state, updates, self.kernel, self.how)
        else:
            g, self.state = update_select(self.graph, self.state, updates, self.kernel, self.source)
        batch = batch if batch is not None else self.last + 1
        if self.folder:
            # the state is written last, so a batch with it is whole; older batches aren't needed any more
            path = f"{self.folder}/{batch}"
            g.edges.write.mode("overwrite").parquet(f"{path}/edges")
            self.state.write.mode("overwrite").parquet(f"{path}/state")
            self._load(batch)
            for name in list_path(g.vertices.sparkSession, self.folder):
                if int(name) < batch:
                    remove_path(g.vertices.sparkSession, f"{self.folder}/{name}")
        else:
            self.graph = Graph(g.vertices, cut(g.edges), g.directed)
        self.last = batch

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts a query that applies each micro-batch; ``trigger`` as for ``DataStreamWriter.trigger``."""
        writer = stream.writeStream.foreachBatch(lambda df, i: self.apply(df, i)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
