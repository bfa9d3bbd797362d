"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

The encoding of a prefix ends in one unique token, and the encoding of the whole is found backwards
through these last tokens. For each prefix an automaton yields the pieces that end there; the piece
that belongs is the only one whose predecessor (the last token of the prefix before it) is
compatible, that is, the merges leave exactly that pair when both are written side by side. Ids are
then recovered from the end.

Characters that no piece holds become their UTF-8 bytes' ids, and cut the text: no piece spans them.
The text is likewise cut wherever no piece holds the two characters on either side next to each
other, so a text is a sequence of short chunks and equal chunks share one table (a bounded memo).

The model must have the identity normaliser, a dummy prefix, no removal of white space and byte
fallback, as checked on loading; ``encode`` raises otherwise.

Edge cases: null is the empty text (begin and end ids only); an empty table gives an empty result;
a very long chunk costs time and memory linear in its length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.worker import kept, map_texts

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MAX_CHUNKS = 100_000
#: Words of either generation of the memo: full, the younger becomes the older, and words met again come back from there.
MAX_WORDS = 200_000
#: Marks, by hash, of words and chunks met once: only from the second time on are they kept.
MARKS = 1 << 21
MEMO_CHARS = 64
MAX_PAIRS = 2_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PrefixTableEncoder:
    """Encodes texts with a SentencePiece BPE model; the library is used to read the model and to decode."""

    def __init__(self, model_file: str) -> None:
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = " A  ﬁ  Ａ\n "
        if sp.encode(probe, out_type=str) and sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model normalises texts; only the identity normaliser is supported")
        special = {i for i in range(sp.vocab_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = [sp.get_score(i) for i in range(sp.vocab_size())]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(sp.is_unknown(i) for i in self.bytes):
            raise ValueError("the model has no byte fallback")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.chars = {c for p in self.ids for c in p}
        self.cut = self._cutter()
        self._formed()
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.met, self.marked = bytearray(MARKS), 0
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))

    def _cutter(self) -> re.Pattern:
        """Chunks: white space, then marks, then other characters; and each line end by itself.

        A mark is a character that no piece holds right after a character that is neither a mark
        nor white space, so that no merge goes over the cut before it.
        """
        beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b[1] == SPACE != b[0] for b in beside) or "\n" in self.chars:
            raise ValueError("a piece goes on after white space")
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        while wrong := {b[1] for b in beside if b[1] in marks and b[0] not in marks and b[0] != SPACE}:
            marks -= wrong
        m = re.escape("".join(sorted(marks)))
        return re.compile(f"{SPACE}*[{m}]*[^{SPACE}\n{m}]+|{SPACE}*[{m}]+|{SPACE}+|\n" if m else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def merge(self, text: str) -> list[int]:
        """The merges themselves, for a piece or a pair of pieces: best score first, then leftmost."""
        ids, n = self.ids, len(text)
        size = [1] * n
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []

        def offer(a: int, b: int) -> None:
            i = ids.get(text[a : b + size[b]])
            if i is not None:
                agenda.append((-self.scores[i], a, size[a] + size[b])) if fresh else heappush(agenda, (-self.scores[i], a, size[a] + size[b]))

        fresh = True
        for k in range(n - 1):
            offer(k, k + 1)
        heapify(agenda)
        fresh = False
        while agenda:
            _, a, width = heappop(agenda)
            b = after[a]
            if not size[a] or b < 0 or size[a] + size[b] != width:
                continue
            self.last_merge = text[a:b], text[b : a + width]
            size[a], size[b] = width, 0
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return [ids.get(text[k : k + size[k]], -1) for k in range(n) if size[k]]

    def _formed(self) -> None:
        """For each piece: whether its characters merge to it, its rank in the order of merges, and its last merge."""
        n = len(self.pieces)
        self.alone, self.rank, self.parts = [False] * n, [0.0] * n, [(-1, -1)] * n
        scores = sorted(self.scores[i] for p, i in self.ids.items() if len(p) > 1)
        self.tied = {x for x, y in zip(scores, scores[1:]) if x == y}
        for piece, i in self.ids.items():
            self.alone[i] = self.merge(piece) == [i]
            self.rank[i] = -self.scores[i] if len(piece) > 1 else -np.inf
            if self.alone[i] and len(piece) > 1:
                self.parts[i] = self.ids.get(self.last_merge[0], -1), self.ids.get(self.last_merge[1], -1)

    def compatible(self, first: int, second: int) -> bool:
        """Whether the merges of both pieces side by side leave exactly this pair.

        The merges are undone from the last to the first, watching the two symbols that face each
        other: none may have formed a piece together before one of them was used up. Of merges of
        one rank the leftmost comes first. Pieces with tied ranks are merged outright.
        """
        ids, pieces, rank, parts = self.ids, self.pieces, self.rank, self.parts
        if -rank[first] in self.tied or -rank[second] in self.tied:
            return self.merge(pieces[first] + pieces[second]) == [first, second]
        limit, by_right = np.inf, False
        while True:
            joined = ids.get(pieces[first] + pieces[second])
            if joined is not None and (rank[joined] < limit or (by_right and rank[joined] == limit)):
                return False
            if rank[first] > rank[second]:
                limit, by_right, first = rank[first], False, parts[first][1]
            elif rank[second] > -np.inf:
                limit, by_right, second = rank[second], True, parts[second][0]
            else:
                return True

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk by the table of its prefixes' last tokens."""
        n, alone, pairs, size = len(chunk), self.alone, self.pairs, len(self.pieces)
        if len(pairs) >= MAX_PAIRS:
            pairs.clear()
        last = [-1] * (n + 1)  # a prefix's last token; -1: it is empty or ends in a character without piece
        back = list(range(-1, n))  # where that token starts
        for end, (width, piece) in self.automaton.iter(chunk):
            end += 1
            if last[end] >= 0:
                continue
            first = last[end - width]
            if first < 0:
                fits = alone[piece]
            else:
                key = first * size + piece
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(first, piece)
            if fits:
                last[end], back[end] = piece, end - width
        found, at = [], n
        while at:
            if last[at] >= 0:
                found.append(last[at])
            elif chunk[at - 1] in self.chars:
                raise ValueError(f"no token ends the prefix {chunk[:at]!r}")
            else:
                found.extend(self.bytes[b] for b in reversed(chunk[at - 1].encode("utf-8", "surrogatepass")))
            at = back[at]
        return tuple(reversed(found))

    def _again(self, part: str) -> bool:
        """Whether the part was met before (or one of the same mark was); notes it."""
        k = hash(part) % MARKS
        if self.met[k]:
            return True
        if self.marked >= MARKS // 2:
            self.met, self.marked = bytearray(MARKS), 0
        self.met[k] = 1
        self.marked += 1
        return False

    def _cut_encode(self, text: str) -> bytes:
        """Packed ids of a text in which spaces are already written as the model does."""
        parts, chunks = [], self.chunks
        for chunk in self.cut.findall(text):
            ids = chunks.get(chunk)
            if ids is None:
                ids = np.array(self.encode_chunk(chunk), "<u4").tobytes()
                if len(chunk) <= MEMO_CHARS and self._again(chunk):
                    if len(chunks) >= MAX_CHUNKS:
                        chunks.clear()
                    chunks[chunk] = ids
            parts.append(ids)
        return b"".join(parts)

    def encode(self, text: str | None) -> bytes:
        """All ids with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.begin + self.end
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            return self.begin + self._cut_encode(SPACE + text.replace(" ", SPACE)) + self.end
        words, parts = self.words, text.split(" ")  # each with one space before it: a cut
        out = [*map(words.get, parts)]
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    ids = self.older.get(parts[k])
                    old = ids is not None
                    if not old:
                        ids = self._cut_encode(SPACE + parts[k])
                    out[k] = ids
                    if old or len(parts[k]) <= MEMO_CHARS and self._again(parts[k]):
                        if len(words) >= MAX_WORDS:
                            self.words, self.older = {}, words
                            words = self.words
                        words[parts[k]] = ids
        return self.begin + b"".join(out) + self.end

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())


def encoder(model_file: str | None = None) -> PrefixTableEncoder:
    """One encoder for each model and Python worker."""
    path = model_file or default_model()
    return kept(f"sentencepiece {path}", lambda: PrefixTableEncoder(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """doc_id, ids (array) and the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for batch in batches:
            ids = [enc.encode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"]
            )

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, ids array<long>, decoded string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; ids don't leave the Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for x in batch.column(1):
                ids = enc.encode(x.as_py())
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(enc.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
