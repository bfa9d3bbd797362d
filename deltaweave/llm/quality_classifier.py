"""Quality classifier: an interpolated modified Kneser-Ney model of each language's trusted text.

Trusted documents are those labelled ``quality = 1``. All documents are dealt into ``FOLDS`` folds by a
hash of the id, and each fold has a model of its own, counted on the trusted documents of the other
folds. So every document is scored by a model that has not seen it, trusted ones too, and all trusted
documents of a language give its quantiles: the median m of the logarithm x of the perplexity, and the
quantile ``QUANTILE`` of the excess (x - m) sqrt(n / (n + PRIOR)) over n characters, since means over
few characters vary more. A document whose excess is over that quantile is rejected; ``threshold`` states
this as a perplexity. A language with too few trusted documents for such a quantile (fewer than
1 / (1 - QUANTILE)) takes the greatest excess among them or the quantile over all languages' excesses,
whichever is more.

The model is over characters, n-grams up to ``ORDER``; a character is a 12-bit class (itself up to
U+0DFF, 512 classes for the rest), so an n-gram is an exact 60-bit integer and shorter n-grams are
cut from it by shifts. Only the longest n-grams are counted on text; continuation counts, discounts,
contexts' weights and interpolated probabilities come from aggregates and joins of that table.

The model is cut into shards by n-gram, each of so many rows, whose bytes are counted. Up to
``MAX_MODEL_BYTES`` in all they are broadcast one by one and joined with the n-gram counts of the
documents that a task has at hand; documents aren't shuffled. Beyond it the n-gram counts of documents
are shuffled and joined with the model instead, row by row with equal results.

Edge cases: null text is the empty text (its end is still scored); null language is a language of
its own; documents of a language without trusted documents in the other folds have no perplexity and
are kept; repeated rows give repeated results; without labels everything is kept; other columns are
ignored. Rows without an id are one fold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaweave.llm.worker import kept, map_texts
from deltaweave.session import materialize

ORDER = 5
BITS = 12
START, END = 2, 3
FOLDS = 2
QUANTILE = 0.99
PRIOR = 1000
#: Step of the logarithms of which quantiles are taken.
GRID = 1e-4
#: A row of the model as workers hold it: an n-gram and the logarithm of a probability or weight.
ROW_BYTES = 8 + 4
SHARD_ROWS = 500_000
MAX_MODEL_BYTES = 192 << 20
MAX_SENT_IDS = 1_000_000
CHUNK_CHARS = 400_000
#: Distinct n-grams that a counting task holds before it adds them up, and before it hands them on.
HELD_KEYS = 1_000_000
CLASSES = 1 << BITS

VERDICT = "doc_id long, lang string, perplexity double, threshold double, kept boolean"


def classes(text: str | None) -> np.ndarray:
    """Character classes of a text."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(codes < 0xE00, codes, 0xE00 + codes % 512)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of length ORDER, one for each character and each end, and where each text begins."""
    pad, end = np.full(ORDER - 1, START, np.int64), np.array([END], np.int64)
    parts = [np.concatenate([pad, classes(t), end]) for t in texts]
    sizes = np.array([len(p) - ORDER + 1 for p in parts])
    flat = np.concatenate(parts)
    keys = np.zeros(len(flat) - ORDER + 1, np.int64)
    for k in range(ORDER):
        keys = keys << BITS | flat[k : k + len(keys)]
    # windows that begin in one text and end in the next are left out
    ends = np.cumsum([len(p) for p in parts])
    keep = np.ones(len(keys), bool)
    for e in ends[:-1]:
        keep[e - ORDER + 1 : e] = False
    return keys[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    at = 0
    while at < len(texts):
        n, first = 0, at
        while at < len(texts) and (n == 0 or n + len(texts[at] or "") < CHUNK_CHARS):
            n += len(texts[at] or "") + 1
            at += 1
        yield first, texts[first:at]


def _by_language(batch: pa.RecordBatch, lang: int, text: int) -> Iterator[tuple[str, list[int], list[str | None]]]:
    groups: dict[str, list[int]] = {}
    for k, x in enumerate(batch.column(lang).to_pylist()):
        groups.setdefault(x if x is not None else "", []).append(k)
    texts = batch.column(text).to_pylist()
    for name, rows in groups.items():
        yield name, rows, [texts[k] for k in rows]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over whole texts; each task adds up what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, n = _added(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for name, _, texts in _by_language(batch, 0, 1):
                for _, part in _chunks(texts):
                    keys, n = np.unique(ngrams(part)[0], return_counts=True)
                    held.setdefault(name, []).append((keys, n.astype(np.int64)))
                    size += len(keys)
                    if size > HELD_KEYS:
                        for other in held:
                            held[other] = [_added(held[other])]
                        size = sum(len(k) for p in held.values() for k, _ in p)
                        if size > HELD_KEYS // 2:
                            yield from flush()
                            size = 0
        yield from flush()

    counted = map_texts(docs.select(F.col("lang").cast("string"), F.col("text").cast("string")), run, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _discounts(n: list[float]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams seen once to four times; fixed ones if any is missing."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k) for k in (1, 2, 3))


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A name and numbers a row, given to Spark as Arrow: rows of Python objects would start Python workers of another kind on the executors, which stay."""
    columns = list(zip(*rows)) or [()] * len(names)
    kinds = [pa.string()] + [pa.float64()] * (len(names) - 1)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names))


def model(counts: DataFrame) -> DataFrame:
    """(lang, part, key, value): part k holds log probabilities of k-grams, part 10 + k the log weights of their contexts."""
    spark = counts.sparkSession
    grams = {ORDER: counts}
    tables = {}
    for k in range(ORDER, 0, -1):
        tables[k] = materialize(grams[k], f"grams{k}") if k < ORDER else grams[k]
        if k > 1:
            mask = (1 << (BITS * (k - 1))) - 1
            grams[k - 1] = tables[k].groupBy("lang", F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.count("*").alias("n"))
    out, lower = None, None
    for k in range(1, ORDER + 1):
        t = tables[k]
        stats = t.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()  # a row for each language
        rows = [(r["lang"], *_discounts([r[f"n{i}"] for i in (1, 2, 3, 4)])) for r in stats]
        d = F.broadcast(_table(spark, rows, ["lang", "d1", "d2", "d3"]))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(d, "lang").select("lang", "key", "n", F.shiftright("key", BITS).alias("context"), cut.alias("cut"))
        contexts = t.groupBy("lang", "context").agg(F.sum("n").cast("double").alias("total"), F.sum("cut").alias("freed"))
        weights = contexts.select("lang", F.lit(10 + k).alias("part"), F.col("context").alias("key"), F.log(F.col("freed") / F.col("total")).alias("value"))
        t = t.join(contexts, ["lang", "context"]).withColumn("own", (F.col("n") - F.col("cut")) / F.col("total")).withColumn("weight", F.col("freed") / F.col("total"))
        if k == 1:
            p = t.select("lang", "key", (F.col("own") + F.col("weight") / CLASSES).alias("p"))
        else:
            mask = (1 << (BITS * (k - 1))) - 1
            low = lower.select("lang", F.col("key").alias("suffix"), F.col("p").alias("low"))
            p = t.withColumn("suffix", F.col("key").bitwiseAND(F.lit(mask))).join(low, ["lang", "suffix"]).select("lang", "key", (F.col("own") + F.col("weight") * F.col("low")).alias("p"))
        lower = materialize(p, f"p{k}")
        both = lower.select("lang", F.lit(k).alias("part"), "key", F.log("p").alias("value")).unionByName(weights)
        out = both if out is None else out.unionByName(both)
    return materialize(out, "model")


class Scorer:
    """The model's shards as one Python worker sees them."""

    def __init__(self, shards: list[dict]) -> None:
        self.shards = shards
        self.languages = {name for s in shards for name, _ in s}

    def _find(self, lang: str, part: int, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, NaN where the model has none: the keys of each shard joined with that shard."""
        out = np.full(len(keys), np.nan)
        for k, shard in enumerate(self.shards):
            if (lang, part) in shard:
                have, values = shard[lang, part]
                mine = np.flatnonzero(keys % len(self.shards) == k) if len(self.shards) > 1 else slice(None)
                wanted = keys[mine]
                at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
                out[mine] = np.where(have[at] == wanted, values[at], np.nan)
        return out

    def log_probabilities(self, lang: str, keys: np.ndarray) -> np.ndarray:
        total, left = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            grams = keys[left] & ((1 << (BITS * k)) - 1)
            value = self._find(lang, k, grams)
            miss = np.isnan(value)
            total[left[~miss]] += value[~miss]
            left, grams = left[miss], grams[miss]
            if not len(left):
                return total
            total[left] += np.nan_to_num(self._find(lang, 10 + k, grams >> BITS))
        total[left] -= np.log(CLASSES)
        return total

    def perplexities(self, lang: str, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), np.nan)
        if lang in self.languages:
            for first, part in _chunks(texts):
                keys, starts = ngrams(part)
                distinct, back = np.unique(keys, return_inverse=True)
                sums = np.add.reduceat(self.log_probabilities(lang, distinct)[back], starts)
                out[first : first + len(part)] = np.exp(-sums / np.diff(np.append(starts, len(keys))))
        return out


class Shards:
    """The model, broadcast shard by shard; ``load`` runs in workers."""

    def __init__(self, spark: SparkSession, table: DataFrame, n: int) -> None:
        self.name, self.parts = uuid.uuid4().hex, []
        for k in range(n):
            part = table.where(F.pmod("key", F.lit(n)) == k).select("lang", "part", "key", F.col("value").cast("float").alias("value")).orderBy("lang", "part", "key").toArrow()
            # names as numbers: a million strings would be most of what the driver holds
            names = part.column("lang").combine_chunks().dictionary_encode()
            codes, orders = names.indices.to_numpy(zero_copy_only=False), part.column("part").to_numpy()
            keys, values = part.column("key").to_numpy(), part.column("value").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (orders[1:] != orders[:-1])])) if len(keys) else []
            shard = {(names.dictionary[int(codes[a])].as_py(), int(orders[a])): (keys[a:b].copy(), values[a:b].copy()) for a, b in zip(cuts, [*cuts[1:], len(keys)])}
            del part, names, codes, orders, keys, values
            self.parts.append(spark.sparkContext.broadcast(shard))

    def load(self) -> Scorer:
        return kept(self.name, lambda: Scorer([p.value for p in self.parts]))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the trusted documents."""
    return labels.where("quality = 1").select(F.col("doc_id").cast("long")).distinct()


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(FOLDS))


def model_name(fold: Column, lang: Column) -> Column:
    """Name of the model that scores documents of a fold and language."""
    return F.concat_ws(":", fold.cast("string"), F.coalesce(lang.cast("string"), F.lit("")))


class Classifier:
    """Fitted models with their languages' thresholds."""

    def __init__(self, docs: DataFrame, labels: DataFrame, max_bytes: int = MAX_MODEL_BYTES, shard_rows: int = SHARD_ROWS) -> None:
        self.spark = docs.sparkSession
        ids = trusted_ids(labels)
        ids = F.broadcast(ids) if ids.count() <= MAX_SENT_IDS else ids
        trusted = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).join(ids, "doc_id")
        counts = count_ngrams(trusted.select(model_name(fold_of(F.col("doc_id")), F.col("lang")).alias("lang"), "text"))
        self.table = model(materialize(_of_other_folds(counts), "ngrams"))
        rows = self.table.count()
        self.shards = Shards(self.spark, self.table, max(-(-rows // shard_rows), 1)) if rows * ROW_BYTES <= max_bytes else None
        held = self.scored(trusted).where("perplexity is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), F.log("perplexity").alias("x"), "n")
        self.limits = limits(materialize(held, "held"))

    def scored(self, docs: DataFrame) -> DataFrame:
        """doc_id, lang, perplexity (null: no model for it), n (characters and the end)."""
        docs = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
        return self._scored_in_place(docs) if self.shards else self._scored_by_join(materialize(docs.withColumn("uid", F.expr("uuid()")), "texts")).drop("uid")

    def _scored_in_place(self, docs: DataFrame) -> DataFrame:
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = shards.load()
            for batch in batches:
                found, n = _perplexities(scorer, batch, 3, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, from_pandas=True), pa.array(n)], ["doc_id", "lang", "perplexity", "n"])

        named = docs.withColumn("_model", model_name(fold_of(F.col("doc_id")), F.col("lang")))
        return map_texts(named, run, "doc_id long, lang string, perplexity double, n long")

    def _scored_by_join(self, docs: DataFrame) -> DataFrame:
        """The same by shuffled joins of each document's n-gram counts with the model, one order after the other; ``uid`` names the rows and is written, so that it stays."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uid, name, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    for _, part in _chunks([text]):
                        keys, n = np.unique(ngrams(part)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([uid] * len(keys), pa.string()), pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["uid", "lang", "key", "n"])

        docs = docs.withColumn("_model", model_name(fold_of(F.col("doc_id")), F.col("lang")))
        rows = map_texts(docs.select("uid", "_model", "text"), run, "uid string, lang string, key long, n long").withColumn("total", F.lit(0.0)).withColumn("open", F.lit(True))
        for k in range(ORDER, 0, -1):
            p = self.table.where(F.col("part") == k).select("lang", F.col("key").alias("g"), F.col("value").cast("float").cast("double").alias("p"))
            w = self.table.where(F.col("part") == 10 + k).select("lang", F.col("key").alias("h"), F.col("value").cast("float").cast("double").alias("w"))
            g = F.col("key").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
            rows = rows.withColumn("g", g).withColumn("h", F.shiftright("g", BITS)).join(p, ["lang", "g"], "left").join(w, ["lang", "h"], "left")
            step = F.when(~F.col("open"), 0.0).when(F.col("p").isNotNull(), F.col("p")).otherwise(F.coalesce("w", F.lit(0.0)))
            rows = rows.select("uid", "lang", "key", "n", (F.col("total") + step).alias("total"), (F.col("open") & F.col("p").isNull()).alias("open"))
        each = F.col("total") - F.when(F.col("open"), F.lit(float(np.log(CLASSES)))).otherwise(0.0)
        sums = rows.groupBy("uid").agg(F.exp(-F.sum(each * F.col("n")) / F.sum("n")).alias("perplexity"), F.sum("n").alias("n"))
        known = self.table.select(F.col("lang").alias("_model")).distinct().withColumn("known", F.lit(True))
        out = docs.drop("text").join(sums, "uid").join(known, "_model", "left")
        return out.select("uid", "doc_id", "lang", F.when(F.col("known"), F.col("perplexity")).alias("perplexity"), "n")

    def verdicts(self, docs: DataFrame) -> DataFrame:
        """See VERDICT; threshold is null where there is no model."""
        return self._judged(self.scored(docs)).select("doc_id", "lang", "perplexity", "threshold", "kept")

    def _judged(self, scored: DataFrame) -> DataFrame:
        limits = _table(self.spark, [(k, *v) for k, v in self.limits.items()], ["_l", "_m", "_limit"])
        scored = scored.join(F.broadcast(limits), F.coalesce("lang", F.lit("")) == F.col("_l"), "left")
        threshold = F.when(F.col("perplexity").isNotNull(), F.exp(F.col("_m") + F.col("_limit") / F.sqrt(F.col("n") / (F.col("n") + PRIOR))))
        return scored.withColumn("threshold", threshold).withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))

    def keep(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs`` that aren't rejected, all columns unchanged."""
        if not self.shards:
            name = f"uid_{uuid.uuid4().hex}"  # a row's own key: ids may be null or repeated
            rows = materialize(docs.withColumn(name, F.expr("uuid()")), "texts")
            texts = rows.select(F.col(name).alias("uid"), F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
            gone = self._judged(self._scored_by_join(texts)).where("not kept").select(F.col("uid").alias(name))
            return rows.join(gone, name, "left_anti").select(docs.columns)
        shards, limits, schema = self.shards, self.limits, docs.schema
        lang, text, width = docs.columns.index("lang"), docs.columns.index("text"), len(docs.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = shards.load()
            for batch in batches:
                found, n = _perplexities(scorer, batch, width, text)
                m, limit = np.array([limits.get(x if x is not None else "", (0.0, np.inf)) for x in batch.column(lang).to_pylist()]).reshape(-1, 2).T
                own = pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width])
                yield own.filter(pa.array(~(found > np.exp(m + limit / np.sqrt(n / (n + PRIOR))))))

        named = docs.withColumn(f"model_{uuid.uuid4().hex}", model_name(fold_of(F.col("doc_id")), F.col("lang")))
        return map_texts(named, run, schema)


def _of_other_folds(counts: DataFrame) -> DataFrame:
    """Counts by the model that they train: a fold's n-grams count for the models of all other folds."""
    fold, lang = F.substring_index("lang", ":", 1).cast("int"), F.expr("substring(lang, instr(lang, ':') + 1)")
    others = F.transform(F.sequence(F.lit(1), F.lit(FOLDS - 1)), lambda k: F.pmod(fold + k, F.lit(FOLDS)))
    rows = counts.select(F.explode(others).alias("_f"), lang.alias("_l"), "key", "n").select(model_name(F.col("_f"), F.col("_l")).alias("lang"), "key", "n")
    return rows if FOLDS == 2 else rows.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _quantile(rows: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """(lang, ``name``): the quantile of a language's rows, or the greatest value in its step of ``GRID``.

    Rows are counted by step first, so one task orders no more rows than there are steps, and the
    result doesn't depend on how the rows are dealt.
    """
    steps = rows.groupBy("lang", F.ceil(F.col(value) / GRID).alias("step")).agg(F.count("*").alias("n"), F.max(value).alias("top"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    whole = F.sum("n").over(Window.partitionBy("lang"))
    reached = steps.withColumn("upto", upto).withColumn("whole", whole).where(F.col("upto") >= F.col("whole") * share)
    return reached.groupBy("lang").agg(F.min_by("top", "step").alias(name))


def limits(held: DataFrame) -> dict[str, tuple[float, float]]:
    """By language: the median and the limit of the excess of trusted documents (lang, x, n); a row for each language."""
    middle = _quantile(held, "x", 0.5, "m")
    excess = held.join(F.broadcast(middle), "lang").withColumn("e", (F.col("x") - F.col("m")) * F.sqrt(F.col("n") / (F.col("n") + PRIOR)))
    most = excess.groupBy("lang", "m").agg(F.max("e").alias("most"), F.count("*").alias("rows"))
    own = most.join(F.broadcast(_quantile(excess, "e", QUANTILE, "limit")), "lang").collect()
    whole = _quantile(excess.select(F.lit("").alias("lang"), "e"), "e", QUANTILE, "limit").first()["limit"] if own else None
    enough = round(1 / (1 - QUANTILE))
    return {r["lang"]: (r["m"], max(r["limit"] if r["rows"] >= enough else max(r["most"], whole), 0.0)) for r in own}


def _perplexities(scorer: Scorer, batch: pa.RecordBatch, lang: int, text: int) -> tuple[np.ndarray, np.ndarray]:
    """Perplexity (NaN: no model) and number of scored characters of each row."""
    out, n = np.full(batch.num_rows, np.nan), np.ones(batch.num_rows, np.int64)
    for name, rows, texts in _by_language(batch, lang, text):
        out[rows] = scorer.perplexities(name, texts)
        n[rows] = [len(t or "") + 1 for t in texts]
    return out, n


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).verdicts(docs)
