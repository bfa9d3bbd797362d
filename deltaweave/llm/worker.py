"""What the Arrow operators share: batches bounded by bytes, and one large object at a time in a Python worker."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a slice that an operator handles at a time; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's default, and the bound that is set in its place: executors hold several copies of a batch outside their heap.
SPARKS, OURS = str(64 << 20), str(4 << 20)

_slot: dict[str, object] = {}


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in pieces of at most ``most`` bytes, or of one row; small batches are put together."""
    held, size = [], 0
    for batch in batches:
        for part in _cut(batch, most):
            if held and size + part.nbytes > most:
                yield _joined(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield _joined(held)


def _cut(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    todo = [(0, batch.num_rows)]
    while todo:
        at, n = todo.pop()
        part = batch.slice(at, n)
        if n > 1 and part.nbytes > most:
            todo += [(at + n // 2, n - n // 2), (at, n // 2)]
        else:
            yield part


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
    return whole[0] if whole else parts[0]


def _freed(run: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``run`` makes of the batches; at the end the worker, which later stages use again, gives back free memory."""
    yield from run(batches)
    _give_back()


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, run: Callable, schema, most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over pieces of about ``most`` bytes, whatever batches Spark makes.

    Spark reads its own bound of a batch's bytes when the plan runs, so it can only be set for the session:
    where it still is Spark's default it becomes 4 MB. Numbers of rows aren't touched, no result depends on
    it, and a bound set by the user stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BOUND).rstrip("b") == SPARKS:
        conf.set(BOUND, OURS)
    return df.mapInArrow(lambda batches: _freed(run, slices(batches, most)), schema)


def kept(name: str, build: Callable[[], object]) -> object:
    """The object of that name, built if this worker doesn't hold it; what another operator left is dropped."""
    if name not in _slot:
        _slot.clear()
        _give_back()
        _slot[name] = build()
    return _slot[name]
