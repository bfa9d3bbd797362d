"""SimHash near-duplicates over deletion-variant signatures.

Fingerprints link when they differ in at most two of 64 bits. They are cut into two segments of 32
bits, one fewer than plain pigeonhole needs: of two linked fingerprints one segment differs in at
most one bit. Each distinct fingerprint is indexed under the 32 one-wildcard variants of either
segment, and equal variants meet in one aggregation:

* a variant with two members gives one candidate pair, which is verified by its Hamming distance;
* a variant with more members isn't expanded into pairs. Its members go to a second index, the 65
  points at distance one or less from a fingerprint. Two fingerprints share such a point exactly if
  they differ in two bits or fewer, and at most 65 distinct fingerprints share one, so linking each
  to the least of its point is exact, needs no verification and has no crowded keys.

Components come from the graph engine's alternating stars over the verified links. Rows learn their
component by a shuffle on the fingerprint, but for hot fingerprints (a group of copies may be a third of
all rows): their components are sent to the rows.

Edge cases: null or empty text has no words and fingerprint 0, linked like any other; texts of one
or two words hash as one shingle; exact copies and repeated rows share a fingerprint and never
become pairs; null doc_id rows get a result but never name a component unless it has no other
member (then null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.worker import map_texts
from deltaweave.operators.components import components
from deltaweave.session import materialize

SEED = 42
SHINGLE = 3
BITS = 2
CHUNK = 1 << 15
#: Distinct fingerprints whose 64 variants one task makes and adds up in memory.
CLASSES_PER_TASK = 4_096
#: Rows of a few ids (8 bytes each) sent to every executor at most; beyond it a join is shuffled.
MAX_SENT_IDS = 1_000_000
#: Copies of a fingerprint from which on its rows aren't shuffled to one task.
HOT_ROWS = 64


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total, ones = 0, np.zeros(64, np.int64)
    n = max(1, len(words) - SHINGLE + 1)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        shingles = zip(part, part[1:], part[2:]) if len(words) >= SHINGLE else [words]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], np.uint64)
        total += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and, if named, the long column ``extra``."""
    more = [extra] if extra else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *more])

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *more), run, "doc_id long, fp long" + "".join(f", {x} long" for x in more))


def links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, whose closure has the components of all links between distinct ``fp``."""
    n = classes.count()
    variants = classes.repartition(max(1, n // CLASSES_PER_TASK), "fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).selectExpr(
        "fp",
        "shiftleft(cast(v as bigint), 32) | (shiftrightunsigned(fp, 32 * (v div 32)) & 4294967295L & ~shiftleft(1L, cast(v % 32 as int))) as variant",
    )
    met = materialize(variants.groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("b"), F.max("fp").alias("a")).where("n > 1"), "variants")
    pairs = met.where(f"n = 2 and bit_count(a ^ b) <= {BITS}").select("a", "b")
    full = met.where("n > 2").select("variant")
    crowded = variants.join(_sent(full), "variant", "left_semi").select("fp").distinct()
    points = crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("v")).selectExpr("fp", "case when v < 0 then fp else fp ^ shiftleft(1L, cast(v as int)) end as point")
    least = points.groupBy("point").agg(F.count("*").alias("n"), F.min("fp").alias("b")).where("n > 1").select("point", "b")
    near = points.join(least, "point").where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(near).distinct()


def hot_size(rows: int) -> int:
    """Members from which on a fingerprint is hot; at most MAX_SENT_IDS fingerprints have so many."""
    return max(HOT_ROWS, -(-rows // MAX_SENT_IDS))


def _grouped(fps: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """``fps`` with component_id. Hot fingerprints' ids are sent to the rows, which stay where they are; the others meet by a shuffle."""
    hot = classes.where(F.col("n") >= hot_size(rows)).select("fp", "component_id")
    sent = fps.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "fp", "left")
    cold = classes.where(F.col("n") < hot_size(rows)).select("fp", "component_id")
    rest = sent.where("_hot is null").drop("_hot", "component_id").join(cold, "fp")
    return sent.where("_hot").drop("_hot").unionByName(rest)


def _classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id, n) of the distinct fingerprints of ``fps`` (doc_id, fp); n is the number of rows."""
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"))).withColumnsRenamed({"node": "fp"})
    named = classes.join(roots, "fp").groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(named, "root").select("fp", "component_id", "root")
    found = classes.join(linked, "fp", "left")
    return found.select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("root", "fp").alias("root"), "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(_classes(fps).drop("root"), "components")
    return _grouped(fps, classes, fps.count()).select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns unchanged: that with the least doc_id (null last, then the least row hash).

    A row is known by its doc_id and the hash of all its columns, so rows of one doc_id with different
    texts are judged apart. Of rows equal in all columns one stays.
    """
    row = F.xxhash64(*[F.col(c) for c in docs.columns])
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), F.col("row").alias("row"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row.alias("row"))
    fps = materialize(fingerprints(texts, extra="row"), "fingerprints")
    each = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min(key).alias("first"), F.count("*").alias("n"))
    classes = materialize(each, "firsts")
    roots = components(links(classes.select("fp"))).select(F.col("node").alias("fp"), "root")
    least = classes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    # what goes: all rows of components of several rows but the first; single rows are never looked up
    several = classes.join(roots, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    told = materialize(several.join(least.select("root", F.col("first").alias("component_id")), "root").select("fp", "component_id", "n"), "told")
    crowd = _grouped(fps.join(_sent(told.select("fp")), "fp", "left_semi"), told, fps.count())
    first = (F.col("component_id.row") == F.col("row")) & F.col("component_id.doc_id").eqNullSafe(F.col("doc_id"))
    crowd = materialize(crowd.select("doc_id", "row", first.alias("first")), "crowd")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (row == F.col("_row"))
    gone = _sent(crowd.where("not first").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct())
    left = docs.join(gone, same, "left_anti")
    again = crowd.where("first").groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    again = materialize(again, "again")
    if again.isEmpty():
        return left
    once = left.join(_sent(again), same, "left_semi").groupBy(F.col("doc_id").alias("_id"), row.alias("_row")).agg(F.first(F.struct(*docs.columns)).alias("_m")).select("_m.*")
    return left.join(_sent(again), same, "left_anti").unionByName(once)


def _sent(ids: DataFrame) -> DataFrame:
    """``ids`` as a broadcast if they are counted to be few, else as they are."""
    return F.broadcast(ids) if ids.count() <= MAX_SENT_IDS else ids
