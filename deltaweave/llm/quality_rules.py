"""Quality rules as a short-circuit cascade.

Every rule is a predicate over lazily computed features of one text. On a sample the cost of each
rule and the share it rejects are measured; the cascade then takes, again and again, the rule that
rejects most per unit of cost among what the rules before it left. A text is dropped by the first
rule that rejects it and later rules aren't evaluated. The verdict is a conjunction, so it does not
depend on the order: the sample decides speed only.

Edge cases: null text is the empty text (no words: ``base_failed``); rules look at the text alone, so a
null language is nothing special; characters whose cases differ in length count one by one; repeated rows give repeated results; an empty table gives an empty result; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.worker import map_texts

# Fixed values.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.1
MIN_ALPHA_WORDS = 0.6
MEAN_WORD = (2.0, 15.0)
MAX_DUP_LINES = 0.5
MAX_UPPER = 0.6
MAX_ELLIPSIS_LINES = 0.3
MAX_BULLET_LINES = 0.9
BULLETS = ("-", "*", "•", "‣", "●")
#: Bounds of the sample that orders the rules: rows, characters of a text, and one row in so many by a hash.
SAMPLE_ROWS = 512
SAMPLE_CHARS = 50_000
SAMPLE_EVERY = 8

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Text:
    """One document; each feature is computed when first asked for and then kept."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")

    def __getattr__(self, name: str):
        value = getattr(type(self), "_" + name)(self)
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return self.raw.split()  # bytes are split at [\x20\x09-\x0D]+

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACES)))

    def _n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    def _lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        """Words in any 3-word window that is found twice or more, the first place included."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        covered = done = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered += i + 3 - max(i, done)
                done = i + 3
        return covered

    def _n_alpha(self) -> int:
        return sum(w.isalpha() or any(map(str.isalpha, w)) for w in (x.decode("utf-8", "surrogatepass") for x in self.words))

    def _letters(self) -> tuple[int, int]:
        """Capitals and cased characters, each character by itself: one that ``lower`` changes, and one that either changes."""
        if self.text.isascii():
            upper, lower = (len(self.raw) - len(self.raw.translate(None, x)) for x in (UPPER, LOWER))
            return upper, upper + lower
        counts = Counter(self.text)
        return sum(n for c, n in counts.items() if c.lower() != c), sum(n for c, n in counts.items() if c.lower() != c or c.upper() != c)

    def _base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes a Text and says whether it has to go."""

    name: str
    rejects: callable


RULES = (
    Rule("few_words", lambda t: t.n_words < MIN_WORDS),
    Rule("symbols", lambda t: t.n_symbols > MAX_SYMBOLS_PER_WORD * max(t.n_words, 1)),
    Rule("mean_word", lambda t: not MEAN_WORD[0] <= t.word_chars / max(t.n_words, 1) <= MEAN_WORD[1]),
    Rule("dup_lines", lambda t: t.n_dup_lines > MAX_DUP_LINES * max(len(t.lines), 1)),
    Rule("ellipsis_lines", lambda t: sum(x.rstrip().endswith((b"...", "…".encode())) for x in t.lines) > MAX_ELLIPSIS_LINES * max(len(t.lines), 1)),
    Rule("bullet_lines", lambda t: sum(x.lstrip().startswith(tuple(b.encode() for b in BULLETS)) for x in t.lines) > MAX_BULLET_LINES * max(len(t.lines), 1)),
    Rule("alpha_words", lambda t: t.n_alpha < MIN_ALPHA_WORDS * t.n_words),
    Rule("upper_case", lambda t: t.letters[0] > MAX_UPPER * max(t.letters[1], 1)),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words),
)


def order_rules(texts: list[str | None], rules: tuple[Rule, ...] = RULES, clock=time.thread_time) -> list[tuple[Rule, float, float]]:
    """Rules with (CPU seconds per text, share rejected) in the order of most rejections per cost.

    Each rule's figures are taken on what the rules chosen before it kept, with the features that
    they have already computed; an empty sample keeps the given order.
    """
    left, rest, out = [Text(t) for t in texts], list(rules), []
    while rest:
        best = None
        for rule in rest:
            # fresh copies, so that each candidate pays for the features that no chosen rule computed
            trial = [_copy(t) for t in left]
            began = clock()
            rejected = [rule.rejects(t) for t in trial]
            cost = (clock() - began) / max(len(trial), 1)
            rate = sum(rejected) / (cost or 1e-9) / max(len(trial), 1)
            if best is None or rate > best[0]:
                best = (rate, rule, cost, rejected, trial)
        _, rule, cost, rejected, trial = best
        out.append((rule, cost, sum(rejected) / max(len(rejected), 1)))
        rest.remove(rule)
        left = [t for t, gone in zip(trial, rejected) if not gone]
    return out


def _copy(t: Text) -> Text:
    new = Text.__new__(Text)
    new.__dict__.update(t.__dict__)
    return new


def cascade(text: Text, rules: list[Rule]) -> str | None:
    """Name of the first rule that rejects the text, or None."""
    return next((r.name for r in rules if r.rejects(text)), None)


def plan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Order of the rules' names, measured on at most ``sample_rows`` texts that a hash of the text chooses.

    The sample reads as many partitions as it takes to find them, and brings at most ``sample_rows`` times
    SAMPLE_CHARS characters to the driver. Longer texts don't take part in it; if none is left, the rules
    keep the order they are given in.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("t")).where(F.coalesce(F.length("t") <= SAMPLE_CHARS, F.lit(True)))
    rows = texts.where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE_EVERY)) == 0).limit(sample_rows).collect()
    return [r.name for r, _, _ in order_rules([x[0] for x in rows], rules)]


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """doc_id and ``failed_rule`` (null: kept): the cascade alone, without counts for texts it drops early."""
    names = order or plan(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [{r.name: r for r in RULES}[n] for n in names]
        for batch in batches:
            failed = [cascade(Text(x.as_py()), rules) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(failed, pa.string())], ["doc_id", "failed_rule"])

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, failed_rule string")


def counts_and_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The base counts of every whole text, ``base_failed`` and ``kept`` (see COUNTS)."""
    names = order or plan(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [{r.name: r for r in RULES}[n] for n in names]
        for batch in batches:
            rows = []
            for x in batch.column(1):
                t = Text(x.as_py())
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, not t.base_failed and cascade(t, rules) is None))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, COUNTS)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_and_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_clean(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` that pass every rule, all columns unchanged; one narrow pass, no join."""
    names = order or plan(docs)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [{r.name: r for r in RULES}[n] for n in names]
        for batch in batches:
            yield batch.filter(pa.array([cascade(Text(x.as_py()), rules) is None for x in batch.column(at)], pa.bool_()))

    return map_texts(docs, run, schema)
