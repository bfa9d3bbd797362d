"""The two fixpoint drivers.

State is a DataFrame keyed by vertex; a round is one join of the active rows with the edges and one
aggregate. Lineage is cut by reliable checkpoints in the shared folder, never kept by an executor.
Nothing but counts and sums comes to the driver. A run that doesn't converge raises ``NotConverged``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from deltaweave.functions.kernels import SelectKernel, SumKernel
from deltaweave.session import cut
from deltaweave.sources.graph import Graph

MAX_ROUNDS = 1_000_000
#: Out-edges from which on a vertex is a hub, whose edges are dealt over salts.
HUB_EDGES = 500_000
#: Groups of sources that are counted first: only in one with more than HUB_EDGES edges can there be a hub.
HUB_GROUPS = 1 << 16
#: Edges from which on a round looks at the frontier alone if that is at most so many rows; smaller graphs are cheaper taken whole.
SPARSE_EDGES = 20_000_000
SPARSE_ROWS = 500_000


class NotConverged(RuntimeError):
    """The fixpoint was not reached in the rounds allowed."""


@dataclass(frozen=True)
class Rounds:
    """How far to go: a fixed number of rounds, or until the pending deltas sum to less than ``threshold`` (for each key, if there are keys).

    A run to a threshold that needs more than ``most`` rounds raises.
    """

    rounds: int | None = None
    threshold: float = 1e-6
    most: int = 1000
    portion: float = 1.0


@dataclass(frozen=True)
class Links:
    """Edges and one ``own`` row for each id, dealt by (src, salt) and kept; ``hubs`` is (id, salts) of split vertices, or None.

    With the own rows a round reads the state once: what a vertex holds and what it sends come out of
    the same join, so several rounds make one plan whose size grows in proportion. A hub's edges lie in
    as many parts as it takes to have at most HUB_EDGES in each, and its state row goes to all of them.
    """

    rows: DataFrame
    hubs: DataFrame | None = None

    def met(self, state: DataFrame, active: Column) -> DataFrame:
        """``state`` joined with its own rows and, where ``active``, with its edges."""
        sent, same = state, F.col("id") == F.col("src")
        if self.hubs is not None:
            salts = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
            sent = state.join(F.broadcast(self.hubs), "id", "left").withColumn("_at", salts).drop("_salts")
            same = same & (F.col("_at") == F.col("salt"))
        # both lie by id already, and the edges in order too: no exchange, and only the state is sorted
        return sent.hint("merge").join(self.rows, same & (F.col("own") | active))

    def unpersist(self) -> None:
        self.rows.unpersist()


def with_own_rows(edges: DataFrame, ids: DataFrame, value: str, hub_edges: int | None = None, counted: DataFrame | None = None) -> Links:
    """See Links; ``hub_edges`` overrides HUB_EDGES. ``counted`` is what hubs are looked for in, if ``edges`` take a join to make: it has all of their sources' edges."""
    most = HUB_EDGES if hub_edges is None else hub_edges
    hubs, salt = None, F.lit(0)
    edges = edges.select("src", "dst", value)
    counted = (edges if counted is None else counted).select(F.col("src").alias("id"), F.pmod(F.xxhash64("src"), F.lit(HUB_GROUPS)).alias("_g"))
    full = [r[0] for r in counted.groupBy("_g").agg(F.count("*").alias("n")).where(F.col("n") > most).select("_g").collect()]
    if full:  # at most as many hubs as that number divides the edges
        found = counted.where(F.col("_g").isin(full)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > most)
        found = cut(found.select("id", F.ceil(F.col("n") / most).cast("int").alias("_salts")))
        if not found.isEmpty():
            hubs = found
            edges = edges.join(F.broadcast(hubs.withColumnRenamed("id", "src")), "src", "left")
            salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst", value), F.col("_salts"))).cast("int")
    own = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast(dict(edges.dtypes)[value]).alias(value), F.lit(True).alias("own"), F.lit(0).alias("salt"))
    rows = edges.select("src", "dst", value, F.lit(False).alias("own"), salt.alias("salt")).unionByName(own)
    by = ["src"] if hubs is None else ["src", "salt"]
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Links(rows.repartition(parts, *by).sortWithinPartitions(*by).persist(), hubs)


def sum_round(state: DataFrame, links: Links, keys: tuple[str, ...] = (), least: float = 0.0, times: float = 1.0) -> DataFrame:
    """One round: active deltas, ``times`` a number, move into the value and, times the factor, along the edges; what moved too much is pending with the other sign.

    Rows with \\|delta\\| not over ``least`` keep their delta pending; ``keys`` are further grouping columns.
    """
    active, own = F.abs("delta") > least, F.col("own")
    sent = links.met(state, active)
    moved, kept = (F.col("delta"), F.lit(0.0)) if times == 1 else (F.col("delta") * times, F.col("delta") * (1 - times))
    value = F.when(own, F.col("value") + F.when(active, moved).otherwise(0.0)).otherwise(0.0)
    delta = F.when(own, F.when(active, kept).otherwise(F.col("delta"))).otherwise(moved * F.col("factor"))
    return sent.select(*keys, F.col("dst").alias("id"), value.alias("value"), delta.alias("delta")).groupBy(*keys, "id").agg(F.sum("value").alias("value"), F.sum("delta").alias("delta"))


def sum_fixpoint(state: DataFrame, factors: DataFrame, n: int, how: Rounds, keys: tuple[str, ...] = (), ids: DataFrame | None = None, cut_every: int = 5, counted: DataFrame | None = None) -> DataFrame:
    """Rounds until ``how`` ends them; (keys, id, value, delta).

    ``ids`` are the vertices that can hold a value; by default those of ``state`` and the targets;
    ``counted`` is for ``with_own_rows``. With ``portion`` under 1 only deltas above that quantile, taken
    anew for each round, are active, and convergence is the same. A run to a threshold is checked at each
    cut, and raises if it doesn't get there.

    Whatever moves, value and pending deltas together stand for the same fixpoint. So a run of all deltas to
    a threshold may hasten: where they mostly have one sign and their sum shrinks by the ratio r in a
    round, all later rounds would bring 1 / (1 - r) times as much of it, and one round moves that.
    """
    done, most, left = 0, how.rounds if how.rounds is not None else how.most, None
    # what may stay pending for ever must be far less than the threshold in all
    least = 0.0 if how.rounds is not None or keys else how.threshold / max(n, 1) * 1e-3
    links = with_own_rows(factors, ids if ids is not None else state.select("id").unionByName(factors.select(F.col("dst").alias("id"))).distinct(), "factor", counted=counted)
    size, portioned, times, bar = F.abs("delta"), how.portion < 1, 1.0, least
    total, quantile = F.sum(size).alias("all"), F.percentile_approx(F.when(size > least, size), 1 - how.portion).alias("bar")
    hastens = how.rounds is None and not keys and not portioned
    try:
        if portioned:
            bar = _bar(state.agg(quantile).first()["bar"], least)
        while done < most:
            seen: list[Observation] = []
            for k in range(1 if portioned else min(cut_every, most - done)):
                state = sum_round(state, links, keys, bar, times)
                done, times = done + 1, 1.0
                if hastens and k >= cut_every - 2:
                    seen.append(Observation())
                    state = state.observe(seen[-1], F.sum("delta").alias("sum"), total)
            if portioned:
                seen.append(Observation())
                state = state.observe(seen[-1], total, quantile)
            state = cut(state)
            if how.rounds is None:
                if seen:
                    left = seen[-1].get["all"] or 0.0
                else:
                    pending = state.groupBy(*keys).agg(total)
                    left = pending.agg(F.max("all")).first()[0] or 0.0
                if left < how.threshold:
                    return state
            if portioned:
                bar = _bar(seen[-1].get["bar"], least)
            elif len(seen) == 2:
                times = _hasty(*[x.get for x in seen])
        if how.rounds is None:
            raise NotConverged(f"{left} is pending after {done} rounds, over the threshold {how.threshold}")
        return state
    finally:
        links.unpersist()


def _bar(found: float | None, least: float) -> float:
    """Deltas over it are active: a hair under the quantile ``found``, so that equal ones are."""
    return max(least, (found or 0.0) * (1 - 1e-9))


def _hasty(before: dict, after: dict) -> float:
    """How many times its deltas the next round moves, from the deltas' sum and absolute sum of two rounds; see ``sum_fixpoint``."""
    ratio = (after["sum"] or 0.0) / before["sum"] if before["sum"] else 0.0
    return 1 / (1 - ratio) if 0 < ratio < 0.95 and abs(after["sum"]) > 0.3 * after["all"] else 1.0


def run_sum(g: Graph, kernel: SumKernel, how: Rounds) -> DataFrame:
    """From the kernel's initial deltas: (id, value, delta)."""
    n = g.vertices.count()
    return sum_fixpoint(kernel.start(g, n), kernel.factors(g.edges), n, how, ids=g.vertices, counted=g.edges)


def select_fixpoint(state: DataFrame, edges: DataFrame, kernel: SelectKernel, keys: tuple[str, ...] = (), ids: DataFrame | None = None, most: int = MAX_ROUNDS, cut_every: int = 3, sparse: bool | None = None, sent: list | None = None) -> DataFrame:
    """Semi-naive rounds until no value improves: (keys, id, value, parent).

    ``state`` holds only vertices with a value. Its column ``round`` marks the frontier (0); rows
    without that column are all frontier. An equal offer of a later round loses, so a parent changes
    only on a strict improvement and parents have no cycles. There are two kinds of rounds:

    * whole: offers and the old state meet in one aggregate over (key, round, parent), a few rounds to
      a cut;
    * sparse, on graphs of over SPARSE_EDGES edges while the frontier has at most SPARSE_ROWS rows: the
      frontier is broadcast to the edges, its offers to the state, and nothing else is shuffled. What
      improves is appended to the state, which is put together again now and then.

    ``sparse`` forces one kind. ``sent`` is a list that takes each round's number of edges over which something was sent.
    """
    if "round" not in state.columns:
        state = state.withColumn("round", F.lit(0))
    state = state.select(*keys, "id", "value", F.col("round").cast("int").alias("round"), "parent")
    sparse = edges.count() > SPARSE_EDGES if sparse is None else sparse
    done, links = 0, None
    if sparse:  # each round looks at all edges, so they are kept where they are
        state, edges = cut(state), edges.select("src", "dst", "weight").persist()
    try:
        while done < most:
            if sparse and (front := cut(state.where("round = 0").select(*keys, "id", "value"))).count() <= SPARSE_ROWS:
                state, rounds, over = _sparse_rounds(state, front, edges, kernel, keys, most - done, sent)
                done += rounds
                if over:
                    break
                continue
            if links is None:
                links = with_own_rows(edges, ids if ids is not None else state.select("id").unionByName(edges.select(F.col("dst").alias("id"))).distinct(), "weight")
            state = _whole_rounds(state, links, kernel, keys, cut_every, sent)
            done += cut_every
            if state.where("round = 0").isEmpty():
                break
        else:
            raise NotConverged(f"values still improve after {done} rounds")
        return state.select(*keys, "id", "value", "parent")
    finally:
        if links is not None:
            links.unpersist()
        if sparse:
            edges.unpersist()


def _best(kernel: SelectKernel) -> Column:
    return F.min(F.struct(kernel.key(F.col("value")).alias("_key"), "round", "parent", "value")).alias("_best")


def reduced(rows: DataFrame, kernel: SelectKernel, keys: tuple[str, ...] = ()) -> DataFrame:
    """The best row (value, round, parent) of each vertex."""
    return rows.groupBy(*keys, "id").agg(_best(kernel)).select(*keys, "id", "_best.value", "_best.round", "_best.parent")


def _whole_rounds(state: DataFrame, links: Links, kernel: SelectKernel, keys: tuple[str, ...], rounds: int, sent: list | None) -> DataFrame:
    """``rounds`` rounds and a cut. They are numbered from there (0: the frontier, -1: before), so every stretch
    is the same plan and its generated code is compiled once."""
    own, counts = F.col("own"), []
    for k in range(rounds):
        met = links.met(state, F.col("round") == k)
        if sent is not None:
            counts.append(Observation())
            met = met.observe(counts[-1], F.coalesce(F.sum((~own).cast("long")), F.lit(0)).alias("n"))
        value = F.when(own, F.col("value")).otherwise(kernel.extend(F.col("value"), F.col("weight")))
        rows = met.select(*keys, F.col("dst").alias("id"), value.alias("value"), F.when(own, F.col("round")).otherwise(k + 1).alias("round"), F.when(own, F.col("parent")).otherwise(F.col("src")).alias("parent"))
        state = reduced(rows, kernel, keys)
    state = cut(state.withColumn("round", F.when(F.col("round") == rounds, 0).otherwise(-1)))
    if sent is not None:
        sent += [c.get["n"] for c in counts]
    return state


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` cut, and its number of rows from the same job."""
    seen = Observation()
    df = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return df, seen.get["n"]


def _sparse_rounds(state: DataFrame, front: DataFrame, edges: DataFrame, kernel: SelectKernel, keys: tuple[str, ...], most: int, sent: list | None) -> tuple[DataFrame, int, bool]:
    """(state, rounds made, whether nothing is left) from rounds that look at the frontier alone."""
    settled, done = state.withColumn("round", F.lit(-1)), 0
    while done < most:
        met = edges.join(F.broadcast(front), F.col("src") == F.col("id"))
        count = Observation()
        met = met.observe(count, F.count(F.lit(1)).alias("n"))
        offers = met.select(*keys, F.col("dst").alias("id"), kernel.extend(F.col("value"), F.col("weight")).alias("value"), F.lit(0).alias("round"), F.col("src").alias("parent"))
        offers, n = _counted(reduced(offers, kernel, keys))
        done += 1
        if sent is not None:
            sent.append(count.get["n"])
        old = settled.join(F.broadcast(offers.select(*keys, "id")), [*keys, "id"], "left_semi") if n <= SPARSE_ROWS else settled
        better, n = _counted(reduced(old.unionByName(offers), kernel, keys).where("round = 0"))
        if n == 0:
            return reduced(settled, kernel, keys), done, True
        settled = settled.unionByName(better.withColumn("round", F.lit(-1)))
        front = better.select(*keys, "id", "value")
        if n > SPARSE_ROWS or done % 8 == 0:
            settled = cut(reduced(settled, kernel, keys))
        if n > SPARSE_ROWS:
            marks = front.select(*keys, "id").withColumn("_f", F.lit(0))
            marked = settled.join(marks, [*keys, "id"], "left").withColumn("round", F.coalesce("_f", F.lit(-1))).drop("_f")
            return cut(marked.select(*keys, "id", "value", "round", "parent")), done, False
    raise NotConverged(f"values still improve after {done} rounds")


def run_select(g: Graph, kernel: SelectKernel, source: int | None = None, sparse: bool | None = None, sent: list | None = None) -> DataFrame:
    """(id, value, parent) of the reached vertices."""
    return select_fixpoint(kernel.start(g, source), g.edges, kernel, ids=g.vertices, sparse=sparse, sent=sent)


def dense(g: Graph, state: DataFrame, kernel: SelectKernel, sentinel: bool = False) -> DataFrame:
    """One row for every vertex; unreachable ones null, or the kernel's sentinel."""
    out = g.vertices.join(state, "id", "left")
    return out.withColumn("value", F.coalesce("value", F.lit(kernel.unreachable))) if sentinel and kernel.unreachable is not None else out
