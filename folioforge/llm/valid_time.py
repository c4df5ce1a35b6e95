"""Valid-time enrichment of sales as a stateful stream: each sale takes its client's version of the time at which it was sold.

Sales and changes come in batches, by arrival. They are written to a new folder under the shared one, batch by batch, and fed in order to a Structured
Streaming query that is started anew for each batch on one checkpoint. Its key is a hash bucket of clients, its state the sorted columns (numpy) of all
versions and waiting sales of these clients. Each batch has one tick for each bucket, with the batch's watermarks, so a bucket moves on without rows
of its own. A bucket resolves all its sales at once: versions are ranked by (client, slice) and time, and one searchsorted over these ranks finds each
sale's last version.

A client that has more than 1 / HOT of all rows (so fewer than HOT of them, which are broadcast), and more than half of an even bucket, is split by time: a slice of its versions and
the sales of the same time go to a bucket of their own. What a slice can't know, it tells in a summary (how many versions it holds, its last one, whether one of them is left from
pruning). Behind the stream, summaries of a client's slices, not its rows, are put together: of the versions that slices kept when they pruned, only that of
the last slice counts, earlier slices hold nothing, and a sale without a version in its slice takes the last one of the slices before.

A batch in short: changes below the changes' watermark are late, the others become versions; then sales, new and waiting, without time or sold before H are
emitted; then of each client's versions up to H all but the last are pruned. H is the smaller of both watermarks, a watermark the largest time of
earlier batches. Behind the last batch the waiting sales are emitted.

Defined cases: a sale without client holds no version; a change without client is late or dropped; a change without time is ignored; equal changes count once
(all columns of the contract alike), different ones of one id as several, told apart by id, then balance, then op; a sale without arrival, a change without id
come in the last batch, rows of before the first day in the first; repeated sales are emitted each; balances that aren't finite are null; empty tables give an empty result; extra columns are
left out, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from .shared import durable, durable_dir

#: Clients with more than 1 / HOT of all rows may be split.
HOT = 1000
#: Rows of a bucket over all batches, at most about.
PER_BUCKET = 3_000_000
#: Before and behind all times, in microseconds since 1970.
NEVER, EVER = -(1 << 62), 1 << 62

TICK, CHANGE, SALE = 0, 1, 2
SOLD, LATE, SLICE = 0, 1, 2
#: What is null (pandas has no null integers), and what a version is.
NO_ID, NO_TIME, NO_CENTS, NO_OP, NO_CLIENT, FOUND, NO_CHANGE, OLD = (1 << n for n in range(8))

#: A tick has H in `at`, the changes' watermark in `cents`. slice: -1 for clients that are not split.
ROWS = "bucket int, kind int, client bigint, slice int, at bigint, id bigint, cents bigint, op string, flags int"
OUT = "rec int, id bigint, batch int, client bigint, slice int, n_held bigint, change_id bigint, cents bigint, op string, flags int"

_VERSION = {"client": np.int64, "slice": np.int32, "at": np.int64, "id": np.int64, "cents": np.int64, "op": np.int32, "flags": np.int32}
_WAITING = {"client": np.int64, "slice": np.int32, "at": np.int64, "id": np.int64, "flags": np.int32}

Columns = dict[str, np.ndarray]


def _taken(c: Columns, which: np.ndarray) -> Columns:
    return {n: x[which] for n, x in c.items()}


def _joined(a: Columns, b: Columns) -> Columns:
    return {n: np.concatenate([a[n], b[n]]) for n in a}


def _none(types: dict) -> Columns:
    return {n: np.zeros(0, t) for n, t in types.items()}


def _first_of_groups(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted rows has other keys than the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


@dataclass
class Held:
    """A bucket's state: versions sorted by client, slice, time and id; waiting sales; the ops that codes stand for."""

    versions: Columns = field(default_factory=lambda: _none(_VERSION))
    waiting: Columns = field(default_factory=lambda: _none(_WAITING))
    ops: list[str] = field(default_factory=list)

    def step(self, batch: int, h: int, changes_from: int, last: bool, rows: pd.DataFrame) -> pd.DataFrame:
        """One batch; what it emits, as OUT."""
        kind = rows["kind"].to_numpy()
        changes, sales = rows[kind == CHANGE], rows[kind == SALE]
        late = changes["at"].to_numpy() < changes_from
        self._learn(changes[~late & (changes["flags"].to_numpy() & NO_CLIENT == 0)])
        sold = _joined(self.waiting, {n: sales[n].to_numpy().astype(t) for n, t in _WAITING.items()})
        go = last | (sold["flags"] & NO_TIME != 0) | (sold["at"] < h)
        self.waiting, sold = _taken(sold, ~go), _taken(sold, go)
        out = [self._late(batch, changes[late]), *self._emitted(batch, sold)]
        if not last:
            self._prune(h)
        return pd.concat(out, ignore_index=True)

    def _learn(self, new: pd.DataFrame) -> None:
        if not len(new):
            return
        code = {op: n for n, op in enumerate(self.ops)}
        for op in new["op"].unique().tolist():
            code.setdefault(op, len(code))
        self.ops = list(code)
        told = {n: (new["op"].map(code) if n == "op" else new[n]).to_numpy().astype(t) for n, t in _VERSION.items()}
        v = _joined(self.versions, told)
        name = np.argsort(np.argsort(np.array(self.ops, object)))[v["op"]]
        order = np.lexsort((name, v["flags"] & NO_OP == 0, v["cents"], v["flags"] & NO_CENTS == 0, v["id"], v["flags"] & NO_ID == 0, v["at"], v["slice"], v["client"]))
        self.versions = _taken(v, order)

    def _late(self, batch: int, changes: pd.DataFrame) -> pd.DataFrame:
        return _told(LATE, batch, changes["id"].to_numpy(), flags=changes["flags"].to_numpy() & NO_ID)

    def _groups(self, sold: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first version of each (client, slice), its group as one number, the group of each sale as such a number, where that stands among the groups)."""
        v = self.versions
        clients = np.unique(np.concatenate([v["client"], sold["client"]]))
        width = 2 + int(max(v["slice"].max(initial=-1), sold["slice"].max(initial=-1)))
        number = lambda c: np.searchsorted(clients, c["client"]) * width + c["slice"] + 1
        begin = np.flatnonzero(_first_of_groups(v["client"], v["slice"]))
        groups, asked = number(_taken(v, begin)), number(sold)
        return begin, groups, asked, np.searchsorted(groups, asked)

    def _emitted(self, batch: int, sold: Columns) -> Iterator[pd.DataFrame]:
        v = self.versions
        begin, groups, asked, at = self._groups(sold)
        size = np.diff(np.append(begin, len(v["at"])))
        known = at < len(groups)
        known[known] = groups[at[known]] == asked[known]
        known &= sold["flags"] & NO_CLIENT == 0
        at[~known] = 0
        # Ranks of (group, time): a version's own, and for a sale that of the last time that isn't behind it.
        times = np.unique(v["at"])
        ranks = np.repeat(np.arange(len(begin)), size) * (len(times) + 1) + np.searchsorted(times, v["at"]) + 1
        place = np.searchsorted(ranks, at * (len(times) + 1) + np.searchsorted(times, sold["at"], side="right"), side="right") - 1
        found = known & (sold["flags"] & NO_TIME == 0)
        found[found] = place[found] >= begin[at[found]]
        n_held = np.zeros(len(at), np.int64)
        n_held[known] = size[at[known]]
        yield self._with_version(_told(SOLD, batch, sold["id"], sold["client"], sold["slice"], n_held, sold["flags"] & (NO_ID | NO_TIME)), place, found)
        # Summaries of slices with versions, and of those that sales have asked for.
        parts = v["slice"][begin] >= 0
        end = (begin + size - 1)[parts]
        told = _told(SLICE, batch, np.zeros(len(end), np.int64), v["client"][end], v["slice"][end], size[parts])
        old = np.logical_or.reduceat(v["flags"] & OLD != 0, begin)[parts] if len(begin) else np.zeros(0, bool)
        told["flags"] |= np.where(old, OLD, 0)
        yield self._with_version(told, end, np.ones(len(end), bool))
        lost = ~known & (sold["slice"] >= 0)
        empty = _taken(sold, lost)
        empty = _taken(empty, np.unique(asked[lost], return_index=True)[1])
        yield _told(SLICE, batch, np.zeros(len(empty["id"]), np.int64), empty["client"], empty["slice"])

    def _with_version(self, out: pd.DataFrame, place: np.ndarray, found: np.ndarray) -> pd.DataFrame:
        v, which = self.versions, place[found]
        for name, of in (("change_id", "id"), ("cents", "cents")):
            out.loc[found, name] = v[of][which]
        out.loc[found, "op"] = np.array(self.ops, object)[v["op"][which]] if len(which) else ""
        flags = v["flags"][which]
        out.loc[found, "flags"] |= FOUND | (flags & (NO_CENTS | NO_OP)) | np.where(flags & NO_ID, NO_CHANGE, 0).astype(np.int32)
        return out

    def _prune(self, h: int) -> None:
        v = self.versions
        if not len(v["at"]):
            return
        past = v["at"] <= h
        ends = np.append(_first_of_groups(v["client"], v["slice"])[1:], True)
        stays = past & (ends | ~np.append(past[1:], False))
        v["flags"] = np.where(stays, v["flags"] | OLD, v["flags"]).astype(np.int32)
        self.versions = _taken(v, ~past | stays)


def _told(rec: int, batch: int, ids: np.ndarray, client=0, slice_=-1, n_held=0, flags=0) -> pd.DataFrame:
    n = len(ids)
    full = lambda x, t: np.broadcast_to(np.asarray(x, t), (n,)).copy()
    return pd.DataFrame(
        {
            "rec": full(rec, np.int32), "id": ids, "batch": full(batch, np.int32), "client": full(client, np.int64), "slice": full(slice_, np.int32), "n_held": full(n_held, np.int64),
            "change_id": full(0, np.int64), "cents": full(0, np.int64), "op": np.full(n, "", object), "flags": full(flags, np.int32),
        }
    )


#: A bucket's state: one value of packed columns.
HELD = ", ".join([*(f"v_{n} binary" for n in _VERSION), *(f"w_{n} binary" for n in _WAITING), "ops array<string>"])


class GroupValue:
    """The state of a group as a value."""

    def __init__(self, state: GroupState):
        self.state = state

    def exists(self) -> bool:
        return self.state.exists

    def get(self) -> tuple:
        return self.state.get

    def update(self, row: tuple) -> None:
        self.state.update(row)


class Buckets:
    """A bucket's step for each batch that has come."""

    def __init__(self, last_batch: int):
        self.last_batch = last_batch

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        self.value = GroupValue(state)
        yield from self.handleInputRows(key, rows, None)

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole, held = pd.concat(list(rows), ignore_index=True), self._read()
        for batch, part in whole.groupby("batch", sort=True):  # one, or several after a failure
            tick = part[part["kind"] == TICK].iloc[0]
            yield held.step(int(batch), int(tick["at"]), int(tick["cents"]), batch > self.last_batch, part)
        told = (held.versions[n].tobytes() for n in _VERSION), (held.waiting[n].tobytes() for n in _WAITING)
        self.value.update((*told[0], *told[1], held.ops))

    def _read(self) -> Held:
        if not self.value.exists():
            return Held()
        row = self.value.get()
        unpacked = [np.frombuffer(bytes(x), t) for x, t in zip(row, [*_VERSION.values(), *_WAITING.values()], strict=False)]
        return Held(dict(zip(_VERSION, unpacked, strict=False)), dict(zip(_WAITING, unpacked[len(_VERSION) :], strict=True)), list(row[-1]))


# The batches


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp as it is written, whatever the session's zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
    return day + F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def batch_number(day: Column, first_day: int, days: int, batches: int) -> Column:
    """The batch of a day since 1970; null days come last."""
    number = F.floor((day - first_day) * batches / days)
    return F.greatest(F.lit(0), F.coalesce(F.least(F.lit(batches - 1), number), F.lit(batches - 1))).cast("int")


def _day(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def _flags(**null: Column) -> Column:
    names = {"no_id": NO_ID, "no_time": NO_TIME, "no_cents": NO_CENTS, "no_op": NO_OP, "no_client": NO_CLIENT}
    out = F.lit(0)
    for name, column in null.items():
        out = out + F.when(column.isNull(), names[name]).otherwise(0)
    return out


CHANGE_COLUMNS = ("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")


@dataclass(frozen=True)
class Folds:
    """How the tables are cut into batches."""

    batches: int = 12
    first_day: int = 19723
    days: int = 152
    delay_days: int = 4
    lag_micros: int = 0


def _tables(sales: DataFrame, changes: DataFrame, folds: Folds) -> DataFrame:
    """Rows of both tables: batch, kind, client, at, id, cents, op, flags."""
    s, c = sales, changes.select(*(c for c in CHANGE_COLUMNS if c in changes.columns)).distinct()
    zero = lambda x: F.coalesce(x, F.lit(0).cast("bigint"))
    at = micros(s["sold_at"])
    sold = s.select(
        batch_number(_day(s["arrived_at"]), folds.first_day, folds.days, folds.batches).alias("batch"), F.lit(SALE).alias("kind"), zero(s["client_id"]).alias("client"), zero(at).alias("at"), zero(s["sale_id"]).alias("id"),
        F.lit(0).cast("bigint").alias("cents"), F.lit("").alias("op"), _flags(no_id=s["sale_id"], no_time=at, no_client=s["client_id"]).alias("flags"),
    )
    c = c.where("valid_at is not null")
    cents = F.when(F.abs(c["balance"]) < 9e16, F.floor(100 * c["balance"] + 0.5))
    day = _day(c["valid_at"]) + F.pmod(F.crc32(c["change_id"].cast("string").cast("binary")), F.lit(folds.delay_days))
    told = c.select(
        batch_number(day, folds.first_day, folds.days, folds.batches).alias("batch"), F.lit(CHANGE).alias("kind"), zero(c["client_id"]).alias("client"), micros(c["valid_at"]).alias("at"), zero(c["change_id"]).alias("id"),
        zero(cents).alias("cents"), F.coalesce(c["op"], F.lit("")).alias("op"), _flags(no_id=c["change_id"], no_cents=cents, no_op=c["op"], no_client=c["client_id"]).alias("flags"),
    )
    return sold.unionByName(told)


def _placed(rows: DataFrame, sales: DataFrame, changes: DataFrame, folds: Folds, buckets: int, total: int) -> DataFrame:
    """rows with slice and bucket."""
    spark = rows.sparkSession
    least = max(total / HOT, total / (2 * buckets))
    counts = sales.select("client_id").unionByName(changes.select("client_id")).where("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hot = [(r.client_id, int(r.n / total * folds.batches * buckets) + 2) for r in counts.collect()]  # fewer than HOT
    split = F.lit(-1)
    if hot:
        rows = rows.join(F.broadcast(spark.createDataFrame(hot, "client bigint, slices int")), "client", "left")
        # Nearly all times lie between these two; the others go to the slices at the ends.
        ends = sales.select(micros(sales["sold_at"]).alias("at")).agg(F.percentile_approx("at", [0.001, 0.999], 1000).alias("p")).first().p or [0, 1]
        share = (F.col("at") - ends[0]) / float(max(ends[1] - ends[0], 1))
        by_time = F.least(F.greatest(F.floor(share * F.col("slices")), F.lit(0)), F.col("slices") - 1)
        by_id = F.pmod(F.xxhash64("id"), F.col("slices"))
        split = F.when(F.col("slices").isNull() | (F.col("flags").bitwiseAND(NO_CLIENT) != 0), -1).when(F.col("flags").bitwiseAND(NO_TIME) != 0, by_id).otherwise(by_time)
    placed = rows.withColumn("slice", split.cast("int"))
    key = F.when(F.col("flags").bitwiseAND(NO_CLIENT) != 0, F.xxhash64("id")).otherwise(F.xxhash64("client", "slice"))
    return placed.withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int")).select("batch", *(x.split()[0] for x in ROWS.split(", ")))


def _watermarks(rows: DataFrame, folds: Folds) -> list[tuple[int, int, int]]:
    """(batch, H, the changes' watermark) of each batch, and of the last emission."""
    maxima = {(r.kind, r.batch): r.at for r in rows.where(F.col("flags").bitwiseAND(NO_TIME) == 0).groupBy("kind", "batch").agg(F.max("at").alias("at")).collect()}  # two for each batch
    out, marks = [], {SALE: NEVER, CHANGE: NEVER}
    for batch in range(folds.batches):
        out.append((batch, min(marks.values()), marks[CHANGE]))
        marks = {k: max(m, maxima.get((k, batch), NEVER + folds.lag_micros) - folds.lag_micros) for k, m in marks.items()}
    return [*out, (folds.batches, EVER, NEVER)]


# The stream

#: Rows of a store over all batches up to which it is a file that a task reads and writes whole; larger ones are in RocksDB.
PER_STORE = 2_000_000
#: A start has one batch: a store is open only while its task runs, and its snapshot is made on commit. RocksDB leaves native memory behind in the executor
#: for each store and start (Spark doesn't free their statistics), so it is for few large stores; these share one memory of bounded size, and each takes
#: little of it before it writes to disk (by default 64 MB each, however many there are).
_STORE = "spark.sql.streaming.stateStore"
STATE = {
    f"{_STORE}.unloadOnCommit": "true",
    f"{_STORE}.minDeltasForSnapshot": "1",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "200",
    f"{_STORE}.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.maxBatchesToRetainInMemory": "1",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # two files for one; the checkpoint goes at the end of the call
}


def _provider(total: int, stores: int) -> dict[str, str]:
    """Where the state of `total` rows in so many stores is kept."""
    kind = "HDFSBackedStateStoreProvider" if total <= PER_STORE * stores else "RocksDBStateStoreProvider"
    return {f"{_STORE}.providerClass": f"org.apache.spark.sql.execution.streaming.state.{kind}"}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and its own ones after that."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _run_batch(spark: SparkSession, root: str, last_batch: int) -> None:
    """Start the query on what has been fed, and wait for its end."""
    fed = spark.readStream.schema(f"{ROWS}, batch int").parquet(f"{root}/feed")
    emitted = fed.groupBy("bucket").applyInPandasWithState(Buckets(last_batch), OUT, HELD, "append", "NoTimeout")
    query = emitted.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _whole(out: DataFrame) -> DataFrame:
    """Emitted sales of split clients put together from the summaries of their slices; others as they are."""
    version = [F.col(c) for c in ("change_id", "cents", "op", "flags")]
    found = F.col("flags").bitwiseAND(FOUND) != 0
    slices = out.where(F.col("rec") == SLICE)
    of_client = Window.partitionBy("client", "batch")
    before = of_client.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = F.max(F.when(F.col("flags").bitwiseAND(OLD) != 0, F.col("slice"))).over(of_client)
    slices = slices.withColumn("first", F.coalesce(first, F.lit(-1)))
    alive = F.col("slice") >= F.col("first")
    told = slices.select(
        "client", "batch", "slice", alive.alias("alive"), F.sum(F.when(alive, F.col("n_held")).otherwise(0)).over(of_client).alias("n_all"),
        F.last(F.when(alive & found, F.struct(*version)), ignorenulls=True).over(before).alias("carried"),
    )
    sold = out.where((F.col("rec") == SOLD) & (F.col("slice") >= 0)).join(told, ["client", "batch", "slice"])
    none = F.struct(F.lit(0).cast("bigint").alias("change_id"), F.lit(0).cast("bigint").alias("cents"), F.lit("").alias("op"), F.lit(0).alias("flags"))
    taken = F.when(~F.col("alive"), none).when(found, F.struct(*version)).otherwise(F.coalesce(F.col("carried"), none))
    # A sale without time takes no version.
    taken = F.when(F.col("flags").bitwiseAND(NO_TIME) != 0, none).otherwise(taken)
    sold = sold.withColumn("taken", taken).select(
        "rec", "id", "batch", F.col("n_all").alias("n_held"), F.col("taken.change_id").alias("change_id"), F.col("taken.cents").alias("cents"), F.col("taken.op").alias("op"),
        F.col("flags").bitwiseAND(NO_ID).bitwiseOR(F.col("taken.flags").bitwiseAND(FOUND | NO_CHANGE | NO_CENTS | NO_OP)).alias("flags"),
    )
    return out.where((F.col("rec") == LATE) | ((F.col("rec") == SOLD) & (F.col("slice") < 0))).select(*sold.columns).unionByName(sold)


def _told_rows(out: DataFrame) -> DataFrame:
    has = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    sale = F.col("rec") == SOLD
    return out.select(
        F.when(sale, "sale").otherwise("late").alias("rec"), F.when(~has(NO_ID), F.col("id")).alias("id"), F.col("batch").cast("bigint").alias("batch"), F.when(sale, F.col("n_held")).alias("n_held"),
        F.when(sale & has(FOUND) & ~has(NO_CHANGE), F.col("change_id")).alias("change_id"), F.when(sale & has(FOUND) & ~has(NO_CENTS), F.col("cents")).alias("balance_cents"),
        F.when(sale & has(FOUND) & ~has(NO_OP), F.col("op")).alias("op"),
    )


def enriched(sales: DataFrame, changes: DataFrame, folds: Folds = Folds()) -> DataFrame:  # noqa: B008
    """rec ('sale' or 'late'), id, batch, n_held, change_id, balance_cents, op of all sales and late changes."""
    spark = sales.sparkSession
    root = f"{durable_dir(spark)}/folioforge/valid-time-{uuid.uuid4().hex}"
    total = sales.count() + changes.count()
    stores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * stores, total // PER_BUCKET)
    rows = _placed(_tables(sales, changes, folds), sales, changes, folds, buckets, total)
    rows.write.partitionBy("batch").parquet(f"{root}/staged")
    staged = spark.read.schema(f"{ROWS}, batch int").parquet(f"{root}/staged")
    marks = spark.createDataFrame(_watermarks(staged, folds), "batch int, h bigint, w bigint")
    tick = marks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).select(
        "batch", "bucket", F.lit(TICK).alias("kind"), F.lit(0).cast("bigint").alias("client"), F.lit(-1).alias("slice"), F.col("h").alias("at"), F.lit(0).cast("bigint").alias("id"),
        F.col("w").alias("cents"), F.lit("").alias("op"), F.lit(0).alias("flags"),
    )
    tick.coalesce(1 + buckets // 100_000).write.mode("append").partitionBy("batch").parquet(f"{root}/staged")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    fs.mkdirs(path(f"{root}/feed"))
    with _settings(spark, STATE | _provider(total, stores)):
        for batch in range(folds.batches + 1):
            fs.rename(path(f"{root}/staged/batch={batch}"), path(f"{root}/feed/batch={batch}"))
            _run_batch(spark, root, folds.batches - 1)
            fs.delete(path(f"{root}/feed/batch={batch}"), True)  # its results and state are at rest
    result = durable(_told_rows(_whole(spark.read.schema(OUT).parquet(f"{root}/out"))), "enriched")
    fs.delete(path(root), True)
    return result
