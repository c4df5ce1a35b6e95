"""Which keys have several owners: rows (key, owner, values) whose key another owner has too.

For keys that are mostly of one owner, as the seeds of passages or the rarest shingles of sets are. Rows don't pass through
the JVM one by one: workers hand on arrays, cut into buckets of keys, and each bucket is sorted in a worker.
A task's rows of a key that has several owners there are known to count: all but two of them (of the least and the greatest owner) go on
beside the buckets, so that a bucket gets two rows of a key from each task at most, however many have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, trim

#: Rows that are sorted together in a worker before they go on.
TOGETHER = 1_000_000

#: Rows of a bucket, which a worker holds at once.
BUCKET = 1_000_000

#: Keys as uint64, owners as int64, then values, each an int64 array.
Rows = tuple[np.ndarray, ...]


def _several(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a row's key has another owner; rows are in order of key and owner."""
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begin, len(key)))
    return np.repeat(owner[begin] != owner[begin + size - 1], size)


def _sorted(rows: Rows) -> Rows:
    order = np.lexsort((rows[1], rows[0]))
    return tuple(x[order] for x in rows)


def _packed(bucket: int, known: bool, rows: Rows) -> pa.RecordBatch:
    columns = [pa.array([x.tobytes()], pa.binary()) for x in rows]
    return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([known], pa.bool_()), *columns], ["bucket", "known", *(f"c{n}" for n in range(len(rows)))])


def _cut(rows: Rows, buckets: int) -> Iterator[pa.RecordBatch]:
    if not len(rows[0]):
        return
    rows = _sorted(rows)
    key, owner = rows[0], rows[1]
    several = _several(key, owner)
    first = np.concatenate(([True], key[1:] != key[:-1]))
    last = np.concatenate((first[1:], [True]))
    beside = several & ~first & ~last
    # Rows that are known to count are spread by their place, not by their key.
    if beside.any():
        rest = tuple(x[beside] for x in rows)
        for n, part in enumerate(np.array_split(np.arange(len(rest[0])), max(1, len(rest[0]) // 50_000))):
            yield _packed(int(rest[1][part[0]] % buckets) if n else int(rest[0][0] % np.uint64(buckets)), True, tuple(x[part] for x in rest))
    rows = tuple(x[~beside] for x in rows)
    # Keys are in order, so a bucket is a range of them.
    width = (1 << 64) // buckets + 1
    cuts = np.searchsorted(rows[0], np.array([min(n * width, (1 << 64) - 1) for n in range(1, buckets)], np.uint64))
    for n, (a, z) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows[0])], strict=True)):
        if a < z:
            yield _packed(n, False, tuple(x[a:z] for x in rows))


def _spread(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], Rows], buckets: int) -> Iterator[pa.RecordBatch]:
    lean()
    held: list[Rows] = []
    size = 0
    for batch in batches:
        held.append(read(batch))
        size += len(held[-1][0])
        if size >= TOGETHER:
            yield from _cut(tuple(map(np.concatenate, zip(*held, strict=True))), buckets)
            held, size = [], 0
    if size:
        yield from _cut(tuple(map(np.concatenate, zip(*held, strict=True))), buckets)
    trim()


def _gather(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket: those whose key has several owners."""
    lean()
    current, held = None, []

    def told(rows: Rows) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x.view(np.int64)) for x in rows], names)

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            rows = _sorted(tuple(map(np.concatenate, zip(*held, strict=True))))
            held.clear()
            several = _several(rows[0], rows[1])
            yield told(tuple(x[several] for x in rows))

    for batch in batches:
        for i in range(batch.num_rows):
            rows = tuple(np.frombuffer(batch.column(n)[i].as_buffer(), np.uint64 if n == 2 else np.int64) for n in range(2, batch.num_columns))
            if batch.column(1)[i].as_py():
                yield told(rows)
                continue
            if (bucket := batch.column(0)[i].as_py()) != current:
                yield from done()
                current = bucket
            held.append(rows)
    yield from done()
    trim()


def shared_keys(df: DataFrame, read: Callable[[pa.RecordBatch], Rows], names: list[str], rows: int) -> DataFrame:
    """The rows (key, owner, values ..., named so, all bigint) that `read` makes of df's batches and whose key has several owners.
    rows: how many there are in all; a bucket holds BUCKET of them or fewer, about."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * tasks, rows // BUCKET + 1)  # several for each task evens them out
    columns = ", ".join(f"c{n} binary" for n in range(len(names)))
    packed = df.mapInArrow(lambda b: _spread(b, read, buckets), f"bucket int, known boolean, {columns}")
    dealt = packed.repartition(tasks, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda b: _gather(b, names), ", ".join(f"{n} bigint" for n in names))
