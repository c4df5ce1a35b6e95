"""Valid-time enrichment as a stateful stream."""

import datetime
import math
import random
import zlib

import pytest

from folioforge.llm import queries, valid_time

from .test_joins import same_rows

DAY0 = datetime.datetime(2024, 1, 1)


def brute(sales, changes, folds):
    """Rows as the batches go, one client and version at a time."""
    span = lambda day: max(0, min(folds.batches - 1, math.floor((day - folds.first_day) * folds.batches / folds.days)))
    number = lambda ts: (ts - datetime.datetime(1970, 1, 1)).days
    came = {b: ([], []) for b in range(folds.batches)}
    for s in sales:
        came[folds.batches - 1 if s["arrived_at"] is None else span(number(s["arrived_at"]))][0].append(s)
    for c in {tuple(c.items()) for c in changes}:
        c = dict(c)
        if c["valid_at"] is not None:
            no = c["change_id"]
            came[folds.batches - 1 if no is None else span(number(c["valid_at"]) + zlib.crc32(str(no).encode()) % folds.delay_days)][1].append(c)
    low = datetime.datetime.min
    ws, wc, held, waiting, out = low, low, {}, [], []
    first = lambda x, least: (x is not None, least if x is None else x)
    key = lambda c: (c["valid_at"], first(c["change_id"], 0), first(c["balance"], 0), first(c["op"], ""))

    def emit(s, b):
        versions = held.get(s["client_id"], []) if s["client_id"] is not None else []
        fit = [c for c in versions if s["sold_at"] is not None and c["valid_at"] <= s["sold_at"]]
        v = max(fit, key=key) if fit else {"change_id": None, "balance": None, "op": None}
        out.append(("sale", s["sale_id"], b, len(versions), v["change_id"], None if v["balance"] is None else math.floor(100 * v["balance"] + 0.5), v["op"]))

    for b in range(folds.batches):
        h = min(ws, wc)
        for c in came[b][1]:
            if c["valid_at"] < wc:
                out.append(("late", c["change_id"], b, None, None, None, None))
            else:
                held.setdefault(c["client_id"], []).append(c)
        waiting, now = [], waiting + came[b][0]
        for s in now:
            emit(s, b) if s["sold_at"] is None or s["sold_at"] < h else waiting.append(s)
        for client, versions in held.items():
            past = sorted((c for c in versions if c["valid_at"] <= h), key=key)
            held[client] = past[-1:] + [c for c in versions if c["valid_at"] > h]
        ws = max([ws, *(s["sold_at"] for s in came[b][0] if s["sold_at"] is not None)])
        wc = max([wc, *(c["valid_at"] for c in came[b][1])])
    for s in waiting:
        emit(s, folds.batches)
    return sorted(map(str, out))


def told(df):
    return sorted(str(tuple(r)) for r in df.select("rec", "id", "batch", "n_held", "change_id", "balance_cents", "op").collect())


SALES = "sale_id bigint, client_id bigint, sold_at timestamp_ntz, arrived_at timestamp_ntz, bucket int, op string"
CHANGES = "change_id bigint, client_id bigint, op string, valid_at timestamp_ntz, balance double, slice int"


def random_tables(rng, n, clients):
    when = lambda days: DAY0 + datetime.timedelta(hours=rng.randrange(24 * days))
    client = lambda: rng.choice([1, 1, None, *range(clients)])
    sales = []
    for i in range(n):
        at = rng.choice([when(20), when(20), when(20), when(20), None])
        arrived = (at or when(20)) + datetime.timedelta(hours=rng.choice([0, 0, 1, 30, 200]))
        sales.append({"sale_id": rng.choice([i, i, i, None, 3]), "client_id": client(), "sold_at": at, "arrived_at": rng.choice([arrived] * 9 + [None])})
    sales += sales[:5]
    changes = [{"change_id": rng.choice([i, i, i, None, 7]), "client_id": client(), "op": rng.choice(["I", "U", "D", None]), "valid_at": rng.choice([when(20)] * 9 + [None]), "balance": rng.choice([None, -1.005, round(rng.uniform(-99, 99), 2)])} for i in range(n)]
    return sales, changes + changes[:7]


@pytest.mark.parametrize(("seed", "clients"), [(1, 3), (2, 40)])
def test_enriched_brute(spark, seed, clients):
    folds = valid_time.Folds(batches=4, first_day=19723, days=20)
    sales, changes = random_tables(random.Random(seed), 300, clients)
    a = spark.createDataFrame([(s["sale_id"], s["client_id"], s["sold_at"], s["arrived_at"], 1, "x") for s in sales], SALES)
    b = spark.createDataFrame([(c["change_id"], c["client_id"], c["op"], c["valid_at"], c["balance"], 2) for c in changes], CHANGES)
    assert told(valid_time.enriched(a, b, folds)) == brute(sales, changes, folds)


def test_enriched_nothing(spark):
    folds = valid_time.Folds(batches=2, days=20)
    sales = spark.createDataFrame([(1, 2, DAY0, DAY0, 1, "x")], SALES)
    changes = spark.createDataFrame([], CHANGES)
    assert told(valid_time.enriched(sales, changes, folds)) == [str(("sale", 1, 2, 0, None, None, None))]
    assert told(valid_time.enriched(sales.where("false"), changes, folds)) == []


def test_state_survives_several_batches_at_once():
    """A bucket that meets two batches in one run (after a failure) goes through them one by one."""
    import pandas as pd

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, row):
            self.held = row

    rng = random.Random(4)
    rows = [(0, k, rng.randrange(3), -1, rng.randrange(100), i, i, "U", 0, b) for b in range(3) for i in range(40) for k in (valid_time.CHANGE, valid_time.SALE)]
    marks = [(valid_time.NEVER, valid_time.NEVER), (30, 40), (60, 60), (valid_time.EVER, valid_time.NEVER)]
    rows += [(0, valid_time.TICK, 0, -1, h, 0, w, "", 0, b) for b, (h, w) in enumerate(marks)]
    frame = pd.DataFrame(rows, columns=[*(x.split()[0] for x in valid_time.ROWS.split(", ")), "batch"])
    told = []
    for cuts in ([[0], [1], [2], [3]], [[0, 1], [2, 3]], [[0, 1, 2, 3]]):
        buckets = valid_time.Buckets(2)
        buckets.value = Value()
        out = [x for cut in cuts for x in buckets.handleInputRows((0,), iter([frame[frame.batch.isin(cut)]]), None)]
        told.append(sorted(map(tuple, pd.concat(out).values.tolist())))
    assert told[0] == told[1] == told[2] and len(told[0]) > 120


def test_op13_sql(spark, sf):
    assert same_rows(queries.op13_valid_time(spark, sf), queries.OP13, sf)


def test_stores_share_bounded_memory():
    settings = {k.rsplit(".", 1)[-1]: v for k, v in valid_time.STATE.items()}
    assert settings["boundedMemoryUsage"] == "true" and int(settings["maxMemoryUsageMB"]) <= 256 and int(settings["writeBufferSizeMB"]) <= 4


@pytest.mark.parametrize("per_store,kind", [(valid_time.PER_STORE, "HDFSBackedStateStoreProvider"), (0, "RocksDBStateStoreProvider")])
def test_stores_close_with_their_tasks(spark, sf, monkeypatch, per_store, kind):
    """Small stores leave nothing in an executor's native memory; large ones are in RocksDB; both give the same rows."""
    used, run = set(), valid_time._run_batch
    setting = lambda name: spark.conf.get(f"spark.sql.streaming.stateStore.{name}")
    monkeypatch.setattr(valid_time, "PER_STORE", per_store)
    monkeypatch.setattr(valid_time, "_run_batch", lambda *a: (used.add((setting("providerClass").rsplit(".", 1)[-1], setting("unloadOnCommit"))), run(*a)))
    assert same_rows(queries.op13_valid_time(spark, sf), queries.OP13, sf)
    assert used == {(kind, "true")}
