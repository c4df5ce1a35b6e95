"""Importance resampling and exact dedup."""

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import exact_dedup, importance, queries

from .test_joins import same_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def brute(docs, target, n, buckets, least, percent):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for f in features(x, n)[1]:
                counts[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc, text in docs:
        words, told = features(text, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in told)
        h = int(sha256(f"2024:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(told), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted(str(tuple(r[:5])) for r in rows)


def told(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


ODD = [None, "", " .,; ", "one", "Ünïcode ÀÉ 漢字 漢字x", "a-b_c d1 2E", "x" * 500 + " " + "y" * 70, "w " * 400]


def random_texts(rng, n):
    return [" ".join(rng.choice("alpha Beta gamma ÄÖ Delta e1 漢字 zeta".split()) + rng.choice(["", ".", str(rng.randrange(30))]) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


@pytest.mark.parametrize(("n", "size"), [(1, 1 << 16), (1, 40), (3, 40), (3, 1)])
def test_resample_brute(spark, n, size):
    rng = random.Random(n)
    rows = [*enumerate(ODD + random_texts(rng, 60)), (None, "alpha beta " * 20), (None, None), (3, "one"), (3, "one"), (9, "b " * 30), (9, "b " * 30)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, row bigint, own string, place int")
    aim = [None, "", *random_texts(rng, 5)]
    target = spark.createDataFrame([(7, x) for x in aim], "row bigint, text string")
    got = told(importance.resample(docs, target, n=n, buckets=100, percent=30, size=size))
    assert got == brute(rows, aim, n, 100, 20, 30)


def test_chunks_own_their_starts():
    rng = random.Random(5)
    for text in [*ODD[1:], *random_texts(rng, 20)]:
        for n, size in ((1, 10), (2, 1), (4, 100)):
            whole = sorted(importance.features([text.encode()], n, 10**6, [None])[0].tolist())
            pieces = list(importance.cut(text.encode(), n, size))
            split = importance.features([p for p, _ in pieces], n, 10**6, [o for _, o in pieces])
            assert sorted(split[0].tolist()) == whole and sum(split[2].tolist()) == features(text, 1)[0]


def test_crc():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    start = np.array([rng.randrange(4000) for _ in range(300)])
    end = start + np.array([rng.choice([0, 1, 5, 63, 64, 65, 900]) for _ in range(300)])
    assert importance.crcs(np.frombuffer(data, np.uint8), start, end).tolist() == [zlib.crc32(data[a:z]) for a, z in zip(start, end, strict=True)]


def test_resample_long_text_and_nothing(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "x" * 1_500_000), (3, "other words")], "doc_id bigint, text string")
    none = docs.where("false")
    target = spark.createDataFrame([("word",)], "text string")
    assert told(importance.resample(docs, target)) == brute([tuple(r) for r in docs.collect()], ["word"], 1, 10000, 20, 10)
    assert told(importance.resample(none, target)) == []
    assert told(importance.resample(docs, target.where("false"), percent=100)) == brute([tuple(r) for r in docs.collect()], [], 1, 10000, 20, 100)


def test_op11_sql(spark, sf):
    assert same_rows(queries.op11_importance(spark, sf), queries.OP11, sf)


# Exact dedup


def dedup_brute(loads):
    """(doc_id, keep_id, group_size, rows kept of the group) of every row."""
    rows = [(d, t or "", k) for k, load in enumerate(loads) for d, t in load]
    out = []
    for d, t, _ in rows:
        same = [x for x in rows if x[1] == t]
        ids = [x[0] for x in same if x[0] is not None]
        out.append((d, max(ids, default=None), len(same)))
    return sorted(map(str, out))


def one_kept_each(found):
    kept = {}
    for r in found:
        kept.setdefault(bytes(r.digest), []).append(r)
    for rows in kept.values():
        (stays,) = [r for r in rows if r.kept]
        assert stays.doc_id == stays.keep_id


@pytest.mark.parametrize(("per_bucket", "together", "hot"), [(1 << 17, 500_000, 1000), (20, 7, 1000), (5, 3, 10)])
def test_exact_dedup_brute(spark, monkeypatch, per_bucket, together, hot):
    for name, value in (("PER_BUCKET", per_bucket), ("TOGETHER", together), ("HOT", hot)):
        monkeypatch.setattr(exact_dedup, name, value)
    rng = random.Random(per_bucket)
    loads = [[(rng.randrange(500) if rng.random() > 0.05 else None, rng.choice(["hot", "", None, f"t{rng.randrange(60)}", f"u{rng.randrange(10**6)}"])) for _ in range(n)] for n in (120, 0, 150)]
    frames = [exact_dedup.digests(spark.createDataFrame([(*r, 5, b"z") for r in load], "doc_id bigint, text string, row int, digest binary")) for load in loads]
    found, index = exact_dedup.exact_groups(frames, exact_dedup.DigestIndex(spark))
    got = found.collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in got) == dedup_brute(loads)
    one_kept_each(got)
    assert index.buckets > 1 or per_bucket > 20


def test_history_is_kept(spark, tmp_path):
    load = lambda *rows: exact_dedup.digests(spark.createDataFrame(list(rows), "doc_id bigint, text string"))
    _, index = exact_dedup.exact_groups([load((5, "a"), (6, "b"), (1, "a"))], exact_dedup.DigestIndex(spark))
    index.save(f"{tmp_path}/index")
    again = exact_dedup.DigestIndex.open(spark, f"{tmp_path}/index")
    found, after = exact_dedup.exact_groups([load((4, "a"), (9, "b"), (5, "a"), (7, "c"))], again)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()) == [(4, 5, 4, False), (5, 5, 4, False), (7, 7, 1, True), (9, 9, 2, True)]
    lost = again.resolve(load((8, "new"), (2, "b")).withColumn("load", F.lit(3)))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in lost.collect()) == [(2, 6, False), (8, None, False)]
    assert after.loads == 2 and [r.doc_id for r in exact_dedup.DigestIndex(spark).resolve(load((8, "x")).withColumn("load", F.lit(0))).collect()] == [8]


def test_perfect_hash():
    words = np.frombuffer(b"".join(sha256(str(i).encode()).digest() for i in range(5000)), np.uint64).reshape(-1, 4)
    sizes, bits = exact_dedup.perfect_hash(words[:4000])
    at = exact_dedup.slots(words[:4000], sizes, bits)
    assert sorted(at.tolist()) == list(range(4000)) and bits.sum() == 4000
    bucket = exact_dedup._Bucket()
    entry = {n: np.zeros(4000, t) for n, t in exact_dedup._TYPES.items()} | {"digest": words[:4000]}
    assert (bucket.with_(entry).find(words) >= 0).tolist() == [True] * 4000 + [False] * 1000


def test_without_copies(spark):
    rows = [(1, "a", 7), (2, "a", 8), (2, "b", 9), (3, "c", 1), (3, "c", 1), (None, "d", 2), (None, None, 3), (4, "", 4), (5, "e" * 1_000_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept int")
    got = exact_dedup.without_copies(docs).collect()
    assert sorted(str((r.doc_id, (r.text or "")[:3], r.kept)) for r in got) == sorted(map(str, [(2, "a", 8), (2, "b", 9), (3, "c", 1), (None, "d", 2), (4, "", 4), (5, "eee", 1)]))
    assert exact_dedup.without_copies(docs.where("false")).count() == 0


def test_op12_sql(spark, sf):
    assert same_rows(queries.op12_exact_dedup(spark, sf), queries.OP12, sf)
