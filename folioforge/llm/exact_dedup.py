"""Exact dedup against everything met so far, through minimal perfect hashes over distinct digests.

A `DigestIndex` is a table at rest, one row for each bucket of digests (a range of their first bits, PER_BUCKET digests about). A bucket's
row holds a minimal perfect hash (levels of bits: a digest's slot is the rank of the first bit that it alone set) and the slots: full
digest, locator of the row that stays (id, load, row of the load) and number of rows. A lookup hashes a digest to a slot and compares
all 32 bytes there, so that digests that the index lacks are told apart from members.

`add` joins a load of rows to an index: workers first reduce their rows to distinct digests with winner and number, so a text that a third of
all rows hold sends a row or two from each task; these are dealt to their buckets, members are counted and compared in their slots, nonmembers are
grouped by themselves, and the bucket's next row is written. Texts are read once, to digest them; only 60 bytes a row move.
`resolve` looks rows up again for their winner. Digests with more than 1 / HOT of all counted rows (so fewer than HOT of them) are
resolved by a broadcast join, as their rows would meet in one bucket; all others are dealt to their buckets.

Of equal texts the row with the largest id stays; of rows equal in id and text the one of the earlier load, and within a load one of them.
Defined cases: a null text is the empty text; a null id is smaller than every id, and a group of null ids alone keeps one of its rows (keep_id null);
repeated rows count and one of them stays; texts of any length are digested by the JVM row by row; an empty table gives an empty result and leaves
the index as it was; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, drop, durable, lean, text_of, trim
from .wordhash import mix

#: Digests of a bucket, about.
PER_BUCKET = 1 << 17
#: Rows that a worker reduces together.
TOGETHER = 500_000
#: A digest with more than 1 / HOT of all rows is resolved by broadcast: there are fewer than HOT of them.
HOT = 1000
#: Bits of a level for each digest that has no slot yet.
GAMMA = 2.0

#: A bucket's row, or a part of a load on its way to the bucket (without levels). Arrays are packed: digest 32 bytes each, noid 1, load 4, else 8.
SCHEMA = "bucket int, part int, levels binary, bits binary, digest binary, id binary, noid binary, load binary, row binary, size binary"
_TYPES = {"digest": np.uint64, "id": np.int64, "noid": np.bool_, "load": np.int32, "row": np.int64, "size": np.int64}
_NAMES = ["bucket", "part", "levels", "bits", *_TYPES]

Entries = dict[str, np.ndarray]  # by the names of _TYPES; digest is an array of four columns


# Minimal perfect hash


def _place(words: np.ndarray, level: int, m: int) -> np.ndarray:
    """Where a level hashes digests: the digest's own words are random already, and are mixed anew for each level."""
    return mix(words[:, level % 4] + mix(words[:, (level + 1) % 4] + np.uint64(level))) % np.uint64(m)


def perfect_hash(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of bits of each level, the bits of all levels) for distinct digests, an array of four 64-bit columns."""
    sizes, bits = [], []
    left = words
    while len(left):
        m = max(64, int(GAMMA * len(left)))
        at = _place(left, len(sizes), m)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        bits.append(alone)
        left = left[~alone[at]]
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(words: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot of each digest; any slot, or -1, for one that was not among those hashed."""
    rank, out, open_ = np.cumsum(bits, dtype=np.int64), np.full(len(words), -1, np.int64), np.arange(len(words))
    base = 0
    for level, m in enumerate(sizes.tolist()):
        at = _place(words[open_], level, m).astype(np.int64) + base
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]] - 1
        open_ = open_[~hit]
        base += m
    return out


# Entries


def _best_first(e: Entries, *groups: np.ndarray) -> np.ndarray:
    """An order by groups (the first one is the outermost) with a group's winner first."""
    return np.lexsort((e["row"], e["load"], ~e["id"], e["noid"], *groups[::-1]))


def _taken(e: Entries, which: np.ndarray) -> Entries:
    return {name: x[which] for name, x in e.items()}


def _together(parts: list[Entries]) -> Entries:
    return {name: np.concatenate([p[name] for p in parts]) for name in _TYPES}


def _reduced(e: Entries) -> Entries:
    """One entry a digest, in order of digests: its winner, and the rows of all."""
    if not len(e["id"]):
        return e
    e = _taken(e, _best_first(e, *e["digest"].T))
    begin = np.flatnonzero(np.concatenate(([True], (e["digest"][1:] != e["digest"][:-1]).any(axis=1))))
    size = np.add.reduceat(e["size"], begin)
    return _taken(e, begin) | {"size": size}


def _buckets_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(bucket: int, part: int, e: Entries, levels: np.ndarray | None = None, bits: np.ndarray | None = None) -> pa.RecordBatch:
    told = [levels if levels is None else levels.tobytes(), bits if bits is None else np.packbits(bits).tobytes(), *(np.ascontiguousarray(e[n]).tobytes() for n in _TYPES)]
    return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in told)], _NAMES)


def _unpacked(batch: pa.RecordBatch, i: int) -> Entries:
    e = {n: np.frombuffer(batch.column(n)[i].as_buffer(), t) for n, t in _TYPES.items()}
    return e | {"digest": e["digest"].reshape(-1, 4)}


class _Bucket:
    """A bucket's hash and slots, unpacked."""

    def __init__(self, batch: pa.RecordBatch | None = None, i: int = 0):
        if batch is None:
            self.entries = {n: np.zeros((0, 4) if n == "digest" else 0, t) for n, t in _TYPES.items()}
            self.levels, self.bits = np.zeros(0, np.int64), np.zeros(0, bool)
        else:
            self.entries = _unpacked(batch, i)
            self.levels = np.frombuffer(batch.column("levels")[i].as_buffer(), np.int64)
            self.bits = np.unpackbits(np.frombuffer(batch.column("bits")[i].as_buffer(), np.uint8), count=int(self.levels.sum())).astype(bool)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Slots of members, -1 for others: the slot's 32 bytes are compared."""
        at = slots(words, self.levels, self.bits)
        maybe = np.flatnonzero(at >= 0)
        at[maybe[(self.entries["digest"][at[maybe]] != words[maybe]).any(axis=1)]] = -1
        return at

    def with_(self, load: Entries) -> _Bucket:
        """The bucket after a load: members in their slots, nonmembers grouped by themselves and hashed with the rest."""
        at = self.find(load["digest"])
        out = _Bucket()
        held, met = self.entries, at >= 0
        if met.any():
            which = np.unique(at[met])
            both = _together([_taken(held, which), _taken(load, np.flatnonzero(met))])
            slot = np.concatenate([which, at[met]])
            order = _best_first(both, slot)
            both, slot = _taken(both, order), slot[order]
            begin = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            held = {n: x.copy() for n, x in held.items()}
            for n in ("id", "noid", "load", "row"):
                held[n][which] = both[n][begin]
            held["size"][which] = np.add.reduceat(both["size"], begin)
        if met.all():
            out.entries, out.levels, out.bits = held, self.levels, self.bits
            return out
        both = _together([held, _reduced(_taken(load, np.flatnonzero(~met)))])
        out.levels, out.bits = perfect_hash(both["digest"])
        order = np.empty(len(both["id"]), np.int64)
        order[slots(both["digest"], out.levels, out.bits)] = np.arange(len(order))
        out.entries = _taken(both, order)
        return out

    def packed(self, bucket: int) -> pa.RecordBatch:
        return _packed(bucket, 0, self.entries, self.levels, self.bits)


# Tasks


def _of_rows(batch: pa.RecordBatch) -> Entries:
    """Entries of rows (doc_id, digest, load, row)."""
    ids = batch.column(0)
    words = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, 4)
    return {
        "digest": words, "id": ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), "noid": ids.is_null().to_numpy(zero_copy_only=False),
        "load": batch.column(2).to_numpy().astype(np.int32), "row": batch.column(3).to_numpy().astype(np.int64), "size": np.ones(len(ids), np.int64),
    }


def _dealt(e: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    """Parts of a load, each of one bucket."""
    of = _buckets_of(e["digest"], buckets)
    order = np.argsort(of, kind="stable")
    e, of = _taken(e, order), of[order]
    begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    for a, z in zip(begin.tolist(), [*begin.tolist()[1:], len(of)], strict=True):
        yield _packed(int(of[a]), 1, _taken(e, slice(a, z)))


def _spread(batches: Iterator[pa.RecordBatch], buckets: int, reduce: bool) -> Iterator[pa.RecordBatch]:
    lean()
    held: list[Entries] = []
    size = 0

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        if size:
            e = _together(held)
            yield from _dealt(_reduced(e) if reduce else e, buckets)
        held, size = [], 0

    for batch in batches:
        if batch.num_rows:
            held.append(_of_rows(batch))
            size += batch.num_rows
        if size >= TOGETHER:
            yield from done()
    yield from done()
    trim()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next index: rows in order of bucket, a bucket's own row first."""
    lean()
    current, bucket, held = None, _Bucket(), []

    def done() -> Iterator[pa.RecordBatch]:
        if current is not None:
            yield (bucket.with_(_reduced(_together(held))) if held else bucket).packed(current)

    for batch in batches:
        for i in range(batch.num_rows):
            at, part = batch.column("bucket")[i].as_py(), batch.column("part")[i].as_py()
            if at != current:
                yield from done()
                current, bucket, held = at, _Bucket(), []
            if part == 0:
                bucket = _Bucket(batch, i)
            else:
                held.append(_unpacked(batch, i))
    yield from done()
    trim()


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of loads with their winners: a bucket's own row comes first, its parts one by one."""
    lean()
    current, bucket = None, _Bucket()
    for batch in batches:
        for i in range(batch.num_rows):
            at = batch.column("bucket")[i].as_py()
            if at != current:
                current, bucket = at, _Bucket()
            if batch.column("part")[i].as_py() == 0:
                bucket = _Bucket(batch, i)
                continue
            e = _unpacked(batch, i)
            slot = bucket.find(e["digest"])
            lost = slot < 0
            slot[lost] = 0
            won = {n: x[slot] if len(x) else np.zeros(len(slot), x.dtype) for n, x in bucket.entries.items() if n != "digest"}
            yield pa.record_batch(
                [
                    pa.array(e["id"], mask=e["noid"]), pa.array(won["id"], mask=won["noid"] | lost), pa.array(won["size"], mask=lost),
                    pa.array(~lost & (won["load"] == e["load"]) & (won["row"] == e["row"])), pa.array([w.tobytes() for w in e["digest"]], pa.binary()),
                ],
                ["doc_id", "keep_id", "group_size", "kept", "digest"],
            )
    trim()


def _hot_entries(batches: Iterator[pa.RecordBatch], above: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            e = _unpacked(batch, i)
            e = _taken(e, np.flatnonzero(e["size"] > above))
            yield pa.record_batch(
                [pa.array([w.tobytes() for w in e["digest"]], pa.binary()), pa.array(e["id"], mask=e["noid"]), pa.array(e["size"]), pa.array(e["load"]), pa.array(e["row"])],
                ["digest", "keep_id", "group_size", "won_load", "won_row"],
            )


# The operator


def as_it_is(text: Column) -> Column:
    return text


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] = as_it_is) -> DataFrame:
    """(doc_id, digest, row) at rest: row tells rows of this table apart."""
    made = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.unhex(F.sha2(normal(text_of(docs, text_col)), 256)).alias("digest"))
    return durable(made.withColumn("row", F.monotonically_increasing_id()), "digests")


@dataclass(frozen=True)
class DigestIndex:
    """All digests of the loads added so far; every load gives the next index. table is None while there are none."""

    spark: SparkSession
    table: DataFrame | None = None
    buckets: int = 0
    loads: int = 0

    @staticmethod
    def open(spark: SparkSession, path: str) -> DigestIndex:
        """An index that `save` wrote."""
        found = spark.read.parquet(path)
        first = found.select("buckets", "loads").first()
        return DigestIndex(spark, found.select(*_NAMES), first.buckets, first.loads) if first else DigestIndex(spark)

    def save(self, path: str) -> None:
        if self.table is not None:
            self.table.withColumns({"buckets": F.lit(self.buckets), "loads": F.lit(self.loads)}).write.parquet(path)

    def _meet(self, rows: DataFrame, buckets: int, reduce: bool) -> DataFrame:
        """The index' rows and those of a load by bucket, the index first."""
        bounded_batches(self.spark)
        parts = rows.select("doc_id", "digest", "load", "row").mapInArrow(lambda b: _spread(b, buckets, reduce), SCHEMA)
        both = parts if self.table is None else self.table.select(*_NAMES).unionByName(parts)
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return both.repartition(max(tasks, buckets // 64), "bucket").sortWithinPartitions("bucket", "part")

    def add(self, rows: DataFrame) -> DigestIndex:
        """With a load of rows (doc_id, digest, row)."""
        held = 0 if self.table is None else (self.table.agg(F.sum(F.octet_length("id"))).first()[0] or 0) // 8
        needed = (held + rows.count()) // PER_BUCKET + 1
        old, buckets = self, max(self.buckets, 1)
        if needed > buckets:  # twice as many as needed, so that this is rare; a bucket's entries go to the buckets that its range is cut into
            buckets = needed if self.table is None else 2 * needed
            if self.table is not None:
                entries = self.table.mapInArrow(lambda b: (x for batch in b for i in range(batch.num_rows) for x in _dealt(_unpacked(batch, i), buckets)), SCHEMA)
                tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                cut = entries.repartition(max(tasks, buckets // 64), "bucket").sortWithinPartitions("bucket", "part").mapInArrow(_merged, SCHEMA)
                old = DigestIndex(self.spark, durable(cut, "digest-index"), buckets, self.loads)
        met = old._meet(rows.withColumn("load", F.lit(self.loads)), buckets, reduce=True)
        out = DigestIndex(self.spark, durable(met.mapInArrow(_merged, SCHEMA), "digest-index"), buckets, self.loads + 1)
        if old is not self:
            drop(old.table)
        return out

    def resolve(self, rows: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, digest) of rows (doc_id, digest, load, row); without winner where the index lacks a digest."""
        if self.table is None:
            return rows.select("doc_id", F.lit(None).cast("bigint").alias("keep_id"), F.lit(None).cast("bigint").alias("group_size"), F.lit(False).alias("kept"), "digest")
        total = self.table.select("size").mapInArrow(_sums, "n bigint").agg(F.sum("n")).first()[0] or 0
        hot = durable(self.table.mapInArrow(lambda b: _hot_entries(b, total / HOT), "digest binary, keep_id bigint, group_size bigint, won_load int, won_row bigint"), "hot")
        quick = rows.join(F.broadcast(hot), "digest").select("doc_id", "keep_id", "group_size", ((F.col("load") == F.col("won_load")) & (F.col("row") == F.col("won_row"))).alias("kept"), "digest")
        rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        found = self._meet(rest, self.buckets, reduce=False).mapInArrow(_resolved, "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, digest binary")
        out = durable(found.unionByName(quick), "resolved")
        drop(hot)
        return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([int(np.frombuffer(x.as_buffer(), np.int64).sum()) for x in batch.column(0)], pa.int64())], ["n"])


def exact_groups(loads: list[DataFrame], history: DigestIndex) -> tuple[DataFrame, DigestIndex]:
    """Rows of all loads (each (doc_id, digest, row), in order of their coming) with their winners after the last one, and the next index."""
    index, numbered = history, []
    for rows in loads:
        numbered.append(rows.withColumn("load", F.lit(index.loads)))
        index, old = index.add(rows), index
        if old is not history:
            drop(old.table)
    whole = numbered[0]
    for rows in numbered[1:]:
        whole = whole.unionByName(rows)
    return index.resolve(whole), index


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns. A text that the history holds stays only with a larger id."""
    rows = digests(docs, id_col, text_col)
    out, index = exact_groups([rows], history or DigestIndex(docs.sparkSession))
    kept = durable(out.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept"), "kept")
    drop(rows, index.table, out)
    digest = F.unhex(F.sha2(text_of(docs, text_col), 256))
    met = lambda some: docs.join(some, docs[id_col].eqNullSafe(some["doc_id"]) & (digest == some["digest"]), "left_semi")
    # Rows that repeat id and text are few: only they are shuffled to leave one of each.
    return met(kept.where("n = 1")).unionByName(met(kept.where("n > 1")).dropDuplicates([id_col, text_col]))
