"""Merkle fixity audit of two replicas of an archive.

Records are hashed over all their named columns; the digests of a range of ``span`` offsets hash to a
leaf, ``fanout`` nodes in order hash to a node above, up to one root. Replicas are compared from the
root down: a level is looked at only below branches that mismatch, to the offsets of the corrupt records.

Edge cases: a null column differs from an empty one; records without an offset, or with a negative one,
share the offset -1, which comes before 0 under the same root; records with one offset are hashed as a
multiset, so repeated rows count and their order does not; an empty replica has no root and all records
of the other are missing or extra; two empty replicas agree; columns that aren't named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.session import materialize

SPAN = 64
FANOUT = 16
#: A SHA-256 is added up in pieces of 32 bits, all of them; a long holds the sum of 2^31 pieces.
PIECES, DIGITS = 8, 8


def record_digests(records: DataFrame, offset: str = "offset", payload: str | tuple[str, ...] = "payload") -> DataFrame:
    """(offset, digest): SHA-256 over the multiset of the offset's records; partial sums meet before the shuffle."""
    parts = []
    for name in [payload] if isinstance(payload, str) else payload:
        p = F.col(name).cast("string")
        parts.append(F.when(p.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), F.length(p).cast("string"), F.lit(":"), p)))
    at = F.greatest(F.coalesce(F.col(offset).cast("long"), F.lit(-1).cast("long")), F.lit(-1).cast("long"))
    rows = records.select(at.alias("offset"), F.sha2(F.concat(*parts), 256).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", DIGITS * k + 1, DIGITS), 16, 10).cast("long")).cast("string").alias(f"s{k}") for k in range(PIECES)]
    whole = rows.groupBy("offset").agg(F.count("*").cast("string").alias("n"), *sums)
    return whole.select("offset", F.sha2(F.concat_ws(":", "n", *[f"s{k}" for k in range(PIECES)]), 256).alias("digest"))


def _leaf(span: int) -> Column:
    """Number of the leaf over an offset; offsets begin at -1."""
    return F.expr(f"(offset + 1) div {span}")


def _parents(nodes: DataFrame, name: str, above: Column) -> DataFrame:
    """Nodes above: a bounded number of children each, hashed in their order."""
    joined = F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct(F.col(name).alias("at"), "digest"))), lambda c: F.concat_ws(":", c["at"].cast("string"), c["digest"])))
    return nodes.groupBy(above.alias("node")).agg(F.sha2(joined, 256).alias("digest"))


class Tree:
    """Digests of all levels, written to shared storage: 0 is records by offset, 1 leaves, the last the root."""

    def __init__(self, records: DataFrame, height: int, span: int = SPAN, fanout: int = FANOUT, offset: str = "offset", payload: str | tuple[str, ...] = "payload") -> None:
        self.levels = [materialize(record_digests(records, offset, payload), "records")]
        level = _parents(self.levels[0], "offset", _leaf(span))
        for k in range(1, height + 1):
            self.levels.append(materialize(level, f"level{k}"))
            level = _parents(self.levels[-1], "node", F.expr(f"node div {fanout}"))

    @property
    def root(self) -> DataFrame:
        return self.levels[-1]


def height(replicas: list[DataFrame], span: int = SPAN, fanout: int = FANOUT, offset: str = "offset") -> int:
    """Levels above the records that bring any offset of the replicas under one root."""
    top = max((r.agg(F.max(F.col(offset).cast("long"))).first()[0] or 0 for r in replicas), default=0)
    nodes, n = (max(top, -1) + 1) // span, 1
    while nodes:
        nodes, n = nodes // fanout, n + 1
    return n


def _differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, in_a, in_b) where digests differ or one side lacks the key."""
    x, y = a.select(key, F.col("digest").alias("x")), b.select(key, F.col("digest").alias("y"))
    return x.join(y, key, "full_outer").where("not x <=> y").select(key, F.col("x").isNotNull().alias("in_a"), F.col("y").isNotNull().alias("in_b"))


def audit(a: Tree, b: Tree, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """(offset, status): ``changed``, ``missing`` (not in b) or ``extra`` (not in a)."""
    levels = len(a.levels) - 1
    bad = None
    for k in range(levels, 0, -1):
        x, y = a.levels[k], b.levels[k]
        if bad is not None:
            up = F.expr(f"node div {fanout}").alias("up")
            x, y = (t.select("*", up).join(bad.withColumnRenamed("node", "up"), "up", "left_semi") for t in (x, y))
        bad = materialize(_differing(x, y, "node").select("node"), f"bad{k}")
        if bad.isEmpty():
            break
    up = _leaf(span).alias("up")
    x, y = (t.levels[0].select("*", up).join(bad.withColumnRenamed("node", "up"), "up", "left_semi") for t in (a, b))
    status = F.when(~F.col("in_b"), "missing").when(~F.col("in_a"), "extra").otherwise("changed")
    return _differing(x, y, "offset").select("offset", status.alias("status"))


def compare(a: DataFrame, b: DataFrame, offset: str = "offset", payload: str | tuple[str, ...] = "payload", span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """The audit of two tables of records."""
    h = height([a, b], span, fanout, offset)
    return audit(Tree(a, h, span, fanout, offset, payload), Tree(b, h, span, fanout, offset, payload), span, fanout)


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` (address and content) against a second replica with planted damage: changed, lost and additional records."""
    first = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    changed = F.when(F.col("page_id") % 101 == 7, F.concat(F.col("html"), F.lit(" "))).when(F.col("page_id") % 211 == 5, F.lit(None)).otherwise(F.col("html"))
    moved = F.when(F.col("page_id") % 223 == 9, F.concat(F.col("url"), F.lit("#"))).otherwise(F.col("url"))
    second = first.select("page_id", moved.alias("url"), changed.alias("html")).where("page_id % 307 <> 11")
    return compare(first.where("page_id % 401 <> 13"), second, "page_id", ("url", "html")).select(F.col("offset").alias("page_id"), "status")


OP10_SQL = """SELECT page_id, CASE WHEN page_id % 307 = 11 THEN 'missing' WHEN page_id % 401 = 13 THEN 'extra' ELSE 'changed' END AS status FROM pages
WHERE CASE WHEN page_id % 401 = 13 THEN page_id % 307 <> 11 ELSE page_id % 307 = 11 OR page_id % 101 = 7 OR page_id % 211 = 5 OR page_id % 223 = 9 END"""
