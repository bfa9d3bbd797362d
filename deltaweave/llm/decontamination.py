"""Benchmark decontamination by the CGK embedding and bit-sampling LSH.

Texts are lower-cased words (``\\w+``; scripts written without spaces give a word for each character).
An item of n words is contained in a document if some stretch of the document is within floor(n / 5)
word edits of it (similarity 0.8 or more); items of under five words have to be found as they are. For
each item size the windows of that size are embedded by CGK random walks, shared with the items: a walk looks at a
word in each step and moves on or stays as a random bit of (step, word) says, so that few edits make
few differing steps. Each of several walks is sampled by several small sets of steps; windows that
agree with an item on all steps of a set become candidates, and each candidate is verified by exact
edit distance between the item and the best stretch around the window.

What the walks miss, which grows with the item's size, is found exactly: an item cut into
floor(n / 5) + 1 pieces keeps at least one piece whole under floor(n / 5) edits, so every place of a
piece of an item is a candidate too. All items within the distance are found, at every size.

Before walking, windows are left out that can't match: at least n - floor(n / 5) words of a window
must be words of items, and of items of n words. Positions in no such window of any size are taken
out first, so that the work for each size is on what is left. Equal windows are walked once.

The items are a query set that goes against all documents in blocks of at most ``BLOCK_WORDS`` words,
each broadcast; documents stay where they are and nothing is shuffled. Of several blocks one is sent at
a time: its matches are written before the next goes out.

Edge cases: null texts and texts without words have none and are contained nowhere; ``min_words``
leaves shorter items out (by default none is); repeated items and rows give repeated results; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.worker import kept, map_texts
from deltaweave.session import materialize

EDIT_SHARE = 5  # one edit for so many words
WALKS = 6
SETS = 12
STEPS = 4
SEED = 20240229
BLOCK_WORDS = 500_000
CHUNK_WORDS = 1_500_000
#: Each item size has steps of its own for all texts at hand, so slices are not small.
SLICE_BYTES = 8 << 20
# Blocks of scripts without spaces between words (Thai and Lao, Myanmar, Khmer, kana, ideographs).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(r"\w+")
UNSPACED_CHARACTER = re.compile(f"[{UNSPACED}]")
WORD_OR_CHARACTER = re.compile(f"[{UNSPACED}]|[^\\W{UNSPACED}]+")

MATCHES = "doc_id long, item_id long, distance long, start_word long, n_words long"


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    spaced = text.isascii() or UNSPACED_CHARACTER.search(text) is None
    return (WORD if spaced else WORD_OR_CHARACTER).findall(text)


def _rows(x: np.ndarray, y: np.ndarray, free_start: bool) -> np.ndarray:
    """Edit distances of the whole of ``x`` to the prefixes of ``y``; with ``free_start`` to their nearest suffixes."""
    at = np.arange(len(y) + 1)
    row = np.zeros_like(at) if free_start else at.copy()
    for k, w in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = k
        np.minimum(row[:-1] + (y != w), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - at) + at
    return row


def edit_span(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``part`` nearest to ``item``; ties: the first end, the longest stretch."""
    forward = _rows(item, part, True)
    end = int(forward.argmin())
    backward = _rows(item[::-1], part[:end][::-1], False)
    return int(forward[end]), end - int(np.flatnonzero(backward == forward[end])[-1]), end


class _Sums:
    """Rolling hashes of windows of words; equal windows have equal hashes."""

    def __init__(self, flat: np.ndarray) -> None:
        powers = np.cumprod(np.full(len(flat) + 1, 0x2545F4914F6CDD1D, np.uint64))
        self.inverse = np.cumprod(np.full(len(flat) + 1, pow(0x2545F4914F6CDD1D, -1, 1 << 64), np.uint64))
        mixed = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[:-1])])

    def windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.inverse[starts]


class Index:
    """LSH tables of one block of items, for one Python worker."""

    def __init__(self, items: list[tuple[int, list[str]]], walks: int = WALKS, sets: int = SETS, steps: int = STEPS, seed: int = SEED) -> None:
        self.items = [(i, w) for i, w in items if w]
        self.vocabulary = {w: k for k, w in enumerate(sorted({x for _, ws in self.items for x in ws}), 1)}
        self.ids = [np.array([self.vocabulary[x] for x in w], np.int32) for _, w in self.items]
        self.sizes: dict[int, list[int]] = {}
        for k, x in enumerate(self.ids):
            self.sizes.setdefault(len(x), []).append(k)
        self.margin = max((n // EDIT_SHARE for n in self.sizes), default=0) + 1
        end = len(self.vocabulary) + 1
        self.seen = np.zeros(end, bool)  # words of the stretch at hand
        self.tables, self.own, self.seeds = {}, {}, {}
        for n, members in sorted(self.sizes.items()):
            rng = np.random.default_rng([seed, n])
            length = 2 * n
            # a step's bit of a word is the top bit of a random linear function of the word's number
            moves = rng.integers(0, 1 << 63, (walks, 2, length), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            chosen = [[np.sort(rng.choice(length, min(steps, length), replace=False)) for _ in range(sets)] for _ in range(walks)]
            flat = np.concatenate([self.ids[k] for k in members])
            starts = np.arange(len(members)) * n
            tables = []
            for row in self._signatures(flat, starts, n, moves, chosen):
                order = np.argsort(row, kind="stable")
                tables.append((row[order], np.array(members)[order]))
            if n >= EDIT_SHARE:
                self.tables[n] = (moves, chosen, tables)
            self.own[n] = np.zeros(end, bool)
            self.own[n][flat] = True
            self.seeds[n] = self._pieces(flat, n, np.array(members))

    def _pieces(self, flat: np.ndarray, n: int, members: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length of piece: sorted hashes of the pieces, their items and their offsets."""
        cuts = np.arange(n // EDIT_SHARE + 2) * n // (n // EDIT_SHARE + 1)
        sizes, sums = np.diff(cuts), _Sums(flat)
        out = {}
        for size in sorted(set(sizes.tolist())):
            offsets = cuts[:-1][sizes == size]
            at = (np.arange(len(members))[:, None] * n + offsets).ravel()
            keys = sums.windows(at, size)
            order = np.argsort(keys, kind="stable")
            out[size] = keys[order], np.repeat(members, len(offsets))[order], np.tile(offsets, len(members))[order]
        return out

    def _signatures(self, flat: np.ndarray, starts: np.ndarray, n: int, moves: np.ndarray, chosen: list[list[np.ndarray]]) -> np.ndarray:
        """For each set of steps of each walk, a hash of the words seen in its steps by that walk from ``starts``."""
        walks, sets = len(chosen), len(chosen[0])
        out = np.full((walks * sets, len(starts)), 0x9E3779B97F4A7C15, np.uint64)
        wanted: dict[int, list[tuple[int, int]]] = {}
        for walk, own in enumerate(chosen):
            for k, steps in enumerate(own):
                for s in steps:
                    wanted.setdefault(int(s), []).append((walk * sets + k, walk))
        # a row for each walk; behind the window's end, where a walk stays, it sees one word that no text has
        end = (starts + n).astype(np.int64)
        ids = np.append(flat, 0).astype(np.uint64)
        at, after = np.tile(starts.astype(np.int64), (walks, 1)), np.uint64(1 << 40)
        a, b, top = moves[:, 0, :, None], moves[:, 1, :, None], np.uint64(63)
        for step in range(max(wanted) + 1):
            inside = at < end
            seen = ids[np.minimum(at, len(flat))]
            np.copyto(seen, after, where=~inside)
            rows = wanted.get(step)
            if rows:
                to, walk = (np.array(x) for x in zip(*rows))
                mixed = (out[to] ^ seen[walk]) * np.uint64(0xD6E8FEB86659FD93)
                out[to] = mixed ^ (mixed >> np.uint64(32))
            seen *= a[:, step]
            seen += b[:, step]
            seen >>= top
            seen &= inside
            at += seen.view(np.int64)
        return out

    def search(self, docs: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(document's place, item's place, distance, start, length) of each contained item's nearest stretch."""
        out, at = [], 0
        while at < len(docs):
            parts, size, first = [], 0, at
            while at < len(docs) and size < CHUNK_WORDS:
                get = self.vocabulary.get
                ids = np.array([get(w, 0) for w in words(docs[at])], np.int32)
                parts.append(ids)
                size += len(ids) + self.margin
                at += 1
            out += [(first + d, *rest) for d, *rest in self._search(parts)]
        return out

    def _search(self, parts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        gap = np.zeros(self.margin, np.int32)  # no match reaches over so many foreign words
        flat = np.concatenate([x for p in parts for x in (p, gap)])
        lows = np.concatenate([[0], np.cumsum([len(p) + self.margin for p in parts])])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        self._short(flat, lows, best)
        place = self._alive(flat)
        flat, whole = flat[place], flat  # windows that jump over what was taken out only cost a verification
        if not len(flat):
            yield from self._ordered(best)
            return
        sums = _Sums(flat)
        for n, (moves, chosen, tables) in self.tables.items():
            k = n // EDIT_SHARE
            span = min(n, len(flat))
            known = np.concatenate([[0], np.cumsum(self.own[n][flat], dtype=np.int32)])
            starts = np.flatnonzero(known[span:] - known[: len(known) - span] >= n - k)
            if not len(starts):
                continue
            _, one, back = np.unique(sums.windows(starts, span), return_index=True, return_inverse=True)
            hits: set[tuple[int, int]] = set()
            for row, (keys, members) in zip(self._signatures(flat, starts[one], n, moves, chosen), tables):
                at = np.minimum(np.searchsorted(keys, row, "left"), len(keys) - 1)
                for w in np.flatnonzero(keys[at] == row):
                    hits.update((int(w), int(m)) for m in members[at[w] : np.searchsorted(keys, row[w], "right")])
            places: dict[int, np.ndarray] = {}
            order = np.argsort(back, kind="stable")
            cuts = np.searchsorted(back[order], np.arange(len(one) + 1))
            for w, item in sorted(hits):
                if w not in places:
                    places[w] = place[starts[order[cuts[w] : cuts[w + 1]]]]
                for p in places[w]:
                    doc = int(np.searchsorted(lows, p, "right")) - 1
                    low, high = max(int(lows[doc]), int(p) - k), min(int(lows[doc + 1]) - self.margin, int(p) + n + k)
                    self._verify(whole, lows, best, doc, item, low, high)
            for doc, item, low, high in self._around_pieces(flat, place, lows, sums, known, starts, n):
                self._verify(whole, lows, best, doc, item, low, high)
        yield from self._ordered(best)

    @staticmethod
    def _ordered(best: dict[tuple[int, int], tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        for (doc, item), (distance, start, length) in sorted(best.items()):
            yield doc, item, distance, start, length

    def _alive(self, flat: np.ndarray) -> np.ndarray:
        """Positions in windows of which enough words are words of items, for any size of items from five words on."""
        known = np.concatenate([[0], np.cumsum(flat > 0, dtype=np.int32)])
        turns = np.zeros(len(flat) + 1, np.int32)
        for n in self.tables:
            span = min(n, len(flat))
            starts = known[span:] - known[: len(known) - span] >= n - n // EDIT_SHARE
            edges = np.diff(starts, prepend=False, append=False)
            at = np.flatnonzero(edges)  # runs of windows begin and end in turn
            turns[at[::2]] += 1
            turns[np.minimum(at[1::2] + span - 1, len(flat))] -= 1
        return np.flatnonzero(np.cumsum(turns[:-1]) > 0)

    def _short(self, flat: np.ndarray, lows: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Puts the first place of each item of under five words into ``best``; they are found as they are."""
        for n, members in self.sizes.items():
            if n >= EDIT_SHARE or len(flat) < n:
                continue
            known = np.concatenate([[0], np.cumsum(self.own[n][flat], dtype=np.int32)])
            at = np.flatnonzero(known[n:] - known[: len(known) - n] == n)
            windows, items = np.lib.stride_tricks.sliding_window_view(flat, n)[at], np.array([self.ids[m] for m in members])
            # a column at a time: the number of each distinct prefix, of items and windows alike
            name = np.zeros(len(items) + len(at), np.int64)
            for c in range(n):
                name = np.unique(name * (len(self.seen) + 1) + np.concatenate([items[:, c], windows[:, c]]), return_inverse=True)[1]
            order = np.argsort(name[: len(items)], kind="stable")
            first = np.searchsorted(name[: len(items)][order], name[len(items) :], "left")
            count = np.searchsorted(name[: len(items)][order], name[len(items) :], "right") - first
            doc = np.searchsorted(lows, at, "right") - 1
            _, once = np.unique(np.stack([doc, name[len(items) :]]), axis=1, return_index=True)  # the first place in each document
            for w in once[count[once] > 0]:
                for m in order[first[w] : first[w] + count[w]]:
                    best[int(doc[w]), members[m]] = (0, int(at[w] - lows[doc[w]]), n)

    def _verify(self, flat: np.ndarray, lows: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]], doc: int, item: int, low: int, high: int) -> None:
        """Puts the nearest stretch of the item within ``low`` and ``high`` into ``best`` if it is near enough and better."""
        found, n = best.get((doc, item)), len(self.ids[item])
        if found and found[0] == 0 and found[1] <= low - int(lows[doc]):
            return
        part, k = flat[low:high], n // EDIT_SHARE
        self.seen[part] = True
        enough = np.count_nonzero(self.seen[self.ids[item]]) >= n - k
        self.seen[part] = False
        if not enough:
            return
        distance, a, b = edit_span(self.ids[item], part)
        new = (distance, low + a - int(lows[doc]), b - a)
        if distance <= k and (found is None or new < found):
            best[doc, item] = new

    def _around_pieces(self, flat: np.ndarray, place: np.ndarray, lows: np.ndarray, sums: _Sums, known: np.ndarray, starts: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, low, high) around each piece of an item of ``n`` words in the windows from ``starts``; what overlaps is one.

        ``flat`` has the words left, and ``place`` says where they stand.
        """
        k = n // EDIT_SHARE
        lengths = np.minimum(np.diff(starts, append=len(flat)), n)
        inside = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        inside = inside[flat[inside] > 0]
        for size, (keys, members, offsets) in self.seeds[n].items():
            at = inside[inside + size <= len(flat)]
            at = at[known[at + size] - known[at] == size]
            wanted = sums.windows(at, size)
            first = np.searchsorted(keys, wanted, "left")
            count = np.searchsorted(keys, wanted, "right") - first
            at, first, count = at[count > 0], first[count > 0], count[count > 0]
            ends = np.cumsum(count)
            done = 0
            while done < len(at):  # so many places at a time
                base = int(ends[done - 1]) if done else 0
                last = max(int(np.searchsorted(ends, base + CHUNK_WORDS, "right")), done + 1)
                c = count[done:last]
                rows = np.repeat(first[done:last] - (ends[done:last] - c - base), c) + np.arange(int(c.sum()))
                here = place[np.repeat(at[done:last], c)]
                done = last
                doc, begin, item = np.searchsorted(lows, here, "right") - 1, here - offsets[rows], members[rows]
                low, high = np.maximum(lows[doc], begin - k), np.minimum(lows[doc + 1] - self.margin, begin + n + k)
                near = known[np.searchsorted(place, high)] - known[np.searchsorted(place, low)] >= n - k
                doc, item, low, high = doc[near], item[near], low[near], high[near]
                if not len(doc):
                    continue
                order = np.lexsort((high, low, item, doc))
                doc, item, low, high = doc[order], item[order], low[order], high[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])]))
                yield from zip(doc[new].tolist(), item[new].tolist(), low[new].tolist(), high[np.append(new[1:], len(high)) - 1].tolist())


def _index(block: _Block) -> Index:
    """The block's index, built once in each Python worker."""
    return kept(block.name, lambda: Index(block.data.value))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = BLOCK_WORDS, min_words: int = 1) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of about ``size`` words; one block is on the driver at a time."""
    block, n = [], 0
    for i, text in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        found = words(text)
        if len(found) < max(min_words, 1):
            continue
        if block and n + len(found) > size:
            yield block
            block, n = [], 0
        block.append((i, found))
        n += len(found)
    if block:
        yield block


class _Block:
    """A broadcast block under a name of its own."""

    def __init__(self, spark: SparkSession, items: list) -> None:
        self.data, self.name = spark.sparkContext.broadcast(items), uuid.uuid4().hex


def _one_at_a_time(found: Iterator, apply: Callable[[_Block], DataFrame], spark: SparkSession) -> Iterator[DataFrame]:
    """``apply`` to each block: all but the last are written and their broadcast is given up."""
    items = next(found, None)
    while items is not None:
        block, items = _Block(spark, items), next(found, None)
        if items is None:
            yield apply(block)
        else:
            yield materialize(apply(block), "block")
            block.data.destroy()


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1, size: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item contained in it (see MATCHES): the nearest stretch of words."""
    spark, out = docs.sparkSession, None

    def apply(block: _Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(block)
            for batch in batches:
                found = index.search(batch.column(1).to_pylist())
                cols = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([index.items[k][0] for k in cols[1]], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "item_id", "distance", "start_word", "n_words"]
                )

        return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, MATCHES, SLICE_BYTES)

    for part in _one_at_a_time(blocks(benchmark, size=size, min_words=min_words), apply, spark):
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], MATCHES)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 1, size: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` that contain no item, all columns unchanged; one narrow pass for each block."""
    at, schema, left = docs.columns.index("text"), docs.schema, docs

    def apply(block: _Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(block)
            for batch in batches:
                bad = {d for d, *_ in index.search(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        return map_texts(left, run, schema, SLICE_BYTES)

    for left in _one_at_a_time(blocks(benchmark, size=size, min_words=min_words), apply, docs.sparkSession):
        pass
    return left
