"""Text formats: edge and vertex lists, update batches, clusters, results."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.session import exists

from .graph import Graph


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither empty nor comments, with their fields ``f``."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    return lines.where("text <> '' and text not like '#%'").select("text", F.split("text", " ").alias("f"), "_file", "_start")


def _in_order(lines: DataFrame) -> DataFrame:
    """With ``line``: what orders lines by their file's name, the part of the file and the row in it.

    Spark packs files into tasks by size, so a row's number alone would not follow the files.
    """
    return lines.withColumn("line", F.struct(F.col("_file").alias("file"), F.col("_start").alias("start"), F.monotonically_increasing_id().alias("row"))).drop("_file", "_start")


def _number(field: Column, kind: str, mode: str) -> Column:
    """A typed field; FAILFAST raises on text that isn't a number, PERMISSIVE gives null."""
    value = F.expr("null") if field is None else field
    parsed = value.try_cast(kind)
    if mode == "PERMISSIVE":
        return parsed
    return F.when(value.isNull() | parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("not a number: "), value)).cast(kind))


def read_edges(spark: SparkSession, path: str, weight_type: str = "long", mode: str = "FAILFAST") -> DataFrame:
    """``src dst [weight]`` lines; without a weight it is 1."""
    f = F.col("f")
    rows = _lines(spark, path).select(
        _number(F.get(f, F.lit(0)), "long", mode).alias("src"), _number(F.get(f, F.lit(1)), "long", mode).alias("dst"), F.coalesce(_number(F.get(f, F.lit(2)), weight_type, mode), F.lit(1).cast(weight_type)).alias("weight")
    )
    return rows.where("src is not null and dst is not null") if mode == "PERMISSIVE" else rows


def read_vertices(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """``id [data]`` lines."""
    return _lines(spark, path).select(_number(F.get("f", F.lit(0)), "long", mode).alias("id"), F.get("f", F.lit(1)).alias("data"))


def read_graph(spark: SparkSession, efile: str, vfile: str | None = None, directed: bool = True, weight_type: str = "long") -> Graph:
    """With an absent or unreadable vertex file the vertices are the endpoints."""
    vertices = read_vertices(spark, vfile) if vfile and exists(spark, vfile) else None
    g = Graph.of(read_edges(spark, efile, weight_type), vertices, directed)
    return g.validate() if vertices is not None else g


def cached_graph(spark: SparkSession, cache: str, efile: str, vfile: str | None = None, directed: bool = True, weight_type: str = "long") -> Graph:
    """``read_graph`` with a cache in the folder ``cache``: Parquet under a key of the files, their change times and the options."""
    stamps = [f"{p}:{_stamp(spark, p)}" for p in (efile, vfile or "") if p]
    path = f"{cache.rstrip('/')}/{hashlib.sha256('|'.join([*stamps, str(directed), weight_type]).encode()).hexdigest()}"
    if not exists(spark, f"{path}/edges/_SUCCESS"):
        read_graph(spark, efile, vfile, directed, weight_type).save(path)
    return Graph.load(spark, path, directed)


def _stamp(spark: SparkSession, path: str) -> str:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return ",".join(f"{x.getPath().getName()}@{x.getModificationTime()}#{x.getLen()}" for x in fs.listStatus(target)) if fs.exists(target) else "absent"


def read_updates(spark: SparkSession, path: str, weight_type: str = "long") -> DataFrame:
    """``a|d src dst [weight]`` lines in their order (``line``); any other operation raises."""
    f = F.col("f")
    op = F.when(F.get(f, F.lit(0)).isin("a", "d"), F.get(f, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("unknown update: "), F.col("text"))).cast("string"))
    number = [_number(F.get(f, F.lit(k)), t, "FAILFAST").alias(n) for k, t, n in ((1, "long", "src"), (2, "long", "dst"), (3, weight_type, "weight"))]
    return _in_order(_lines(spark, path)).select(op.alias("op"), *number, "line")


def read_clusters(spark: SparkSession, path: str, min_size: int = 1) -> DataFrame:
    """``size id id ...`` lines: (id, cluster); a cluster's name is its least id."""
    ids = F.expr("transform(slice(f, 2, size(f)), x -> cast(x as bigint))")
    return _lines(spark, path).select(F.get("f", F.lit(0)).cast("long").alias("size"), ids.alias("ids")).where(F.col("size") >= min_size).select(F.explode("ids").alias("id"), F.array_min("ids").alias("cluster"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate format: ``%`` comments, a line of sizes, then ``row col [value]``."""
    rows = _in_order(_lines(spark, path).where("text not like '\\%%'")).withColumnRenamed("line", "at")
    head = rows.agg(F.min("at").alias("first"))
    body = rows.join(F.broadcast(head), F.col("at") > F.col("first"))
    return body.select(F.get("f", F.lit(0)).cast("long").alias("src"), F.get("f", F.lit(1)).cast("long").alias("dst"), F.coalesce(F.get("f", F.lit(2)).try_cast("double"), F.lit(1.0)).alias("weight"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``src dst dst ...`` lines."""
    return _lines(spark, path).select(F.get("f", F.lit(0)).cast("long").alias("src"), F.explode(F.expr("transform(slice(f, 2, size(f)), x -> cast(x as bigint))")).alias("dst")).withColumn("weight", F.lit(1).cast("long"))


def read_temporal_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``src dst op ...`` lines: op 2 is the base graph, 1 a delete, 4 an add. The last update of a pair wins."""
    rows = _in_order(_lines(spark, path)).select(F.get("f", F.lit(0)).cast("long").alias("src"), F.get("f", F.lit(1)).cast("long").alias("dst"), F.get("f", F.lit(2)).cast("int").alias("code"), "line")
    base = rows.where("code = 2").select("src", "dst").distinct().withColumn("weight", F.lit(1).cast("long"))
    last = rows.where("code in (1, 4)").groupBy("src", "dst").agg(F.max_by("code", "line").alias("code"))
    return base, last.select(F.when(F.col("code") == 4, "a").otherwise("d").alias("op"), "src", "dst", F.lit(1).cast("long").alias("weight"))


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", *edges.columns).alias("value")).write.mode("overwrite").text(path)


def write_updates(updates: DataFrame, path: str) -> None:
    updates.select(F.concat_ws(" ", "op", "src", "dst", "weight").alias("value")).write.mode("overwrite").text(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """``size id id ...`` lines; a cluster's size is bounded by the clusterer."""
    lines = clusters.groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lines.select(F.concat_ws(" ", F.size("ids").cast("string"), F.expr("transform(ids, x -> cast(x as string))")).alias("value")).write.mode("overwrite").text(path)


def write_result(state: DataFrame, path: str, value: str = "value", unreachable: str | None = None) -> None:
    """``id value`` lines; doubles in scientific notation with 15 digits."""
    shown = F.when(F.col(value).isNotNull(), F.format_string("%.15e", value)) if dict(state.dtypes)[value] in ("double", "float") else F.col(value).cast("string")
    state.select(F.concat_ws(" ", F.col("id").cast("string"), F.coalesce(shown, F.lit(unreachable or "null"))).alias("value")).write.mode("overwrite").text(path)
