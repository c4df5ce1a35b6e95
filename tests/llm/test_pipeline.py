"""The pipeline against a Python version of its stages, over the sample table and one of odd rows."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import byte_bpe, quality_rank, queries, secret_scan, source_mixing
from folioforge.llm.shared import durable

from .test_joins import brute_components
from .test_rowwise import base_spans

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def clean(text, model):
    """text with its secrets marked, by loops."""
    width, base = secret_scan.WIDTH, base_spans(text)
    added = []
    for m in RUN.finditer(text):
        codes = [0, *(secret_scan.ALPHABET.find(c) + 1 for c in m[0])]
        total = best = 0.0
        since, where = 0, (0, 0)
        for i in range(len(m[0]) + 1):
            if i == len(m[0]) or total <= 0 or total < best - secret_scan.DROP:
                if best >= secret_scan.THRESHOLD and where[1] - where[0] >= secret_scan.RUN_MIN:
                    a = 0 if where[0] < secret_scan.EDGE else where[0]
                    z = len(m[0]) if len(m[0]) - where[1] < secret_scan.EDGE else where[1]
                    added.append((m.start() + a, 3, m.start() + z))
                total, best, since = 0.0, 0.0, i
            if i < len(m[0]):
                total += round(model[codes[i] * width + codes[i + 1]], 6)
                if total > best:
                    best, where = total, (since, i + 1)
    spans = sorted(base + [s for s in added if not any(b[0] < s[2] and s[0] < b[2] for b in base)])
    out, at = [], 0
    for a, _, z in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def number(*key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:15], 16)


def mixed(rows, limit):
    """(row, epoch) of rows (id, text, source), as often as the plan has them."""
    count = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    key = lambda r: f"={r[0]}" if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
    by = collections.defaultdict(list)
    for r in rows:
        by["null" if r[2] is None else "=" + r[2]].append(r)
    names = sorted(by)
    tokens = [float(sum(count(r[1]) for r in by[n])) for n in names]
    w = source_mixing.weights(tokens, source_mixing.exponent(tokens, max_repeats=limit))
    out = []
    for name, t, n in zip(names, tokens, source_mixing.repeats(tokens, w, None), strict=True):
        whole, part = math.floor(n + 1e-9), max(0.0, n - math.floor(n + 1e-9))
        blocks = max(1, math.ceil((t + len(by[name])) / source_mixing.BLOCK_TOKENS))
        for b in range(blocks):
            own = [r for r in by[name] if number(key(r), 0, "block") % blocks == b]
            sizes = collections.Counter()
            for r in own:
                sizes[number(key(r), 0), key(r)] += count(r[1])
            so_far, taken = 0, set()
            for k in sorted(sizes):
                so_far += sizes[k]
                if part > 0 and so_far - sizes[k] / 2 <= part * sum(sizes.values()):
                    taken.add(k[0])
            cutoff = max(taken, default=-1)
            out += [(r, e) for r in own for e in range(1, whole + (number(key(r), 0) <= cutoff) + 1)]
    return out


def brute(spark, docs, labels):
    """(doc_id, source, ids) of each row of the result; docs: (id, text, lang, source, n_chars)."""
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marks = collections.defaultdict(list)
    for d, q in labels:
        if d is not None and q in (0, 1):
            marks[d].append(q)
    rows = sorted([(max(marks[r[0]]), quality_rank.features(r[1] or "")) for r in docs if r[0] in marks])
    model = quality_rank.fit(np.array([x for _, x in rows]).reshape(len(rows), len(quality_rank.FEATURES)), np.array([m for m, _ in rows]))
    docs = [r for r in docs if model.scores(np.array([quality_rank.features(r[1] or "")]))[0] >= model.threshold]
    found = brute_components([(r[0], r[1]) for r in docs])
    stays = {d for d, _, c in found if d is not None and d == c}
    stays |= {d for d, n, _ in found if n == 0}
    seen, kept = set(), []
    for r in docs:
        if r[0] is None or (r[0] in stays and r not in seen):
            kept.append(r)
            seen.add(r)
    frame = spark.createDataFrame(kept, frame.schema)
    markov = secret_scan.train(secret_scan.samples_of(frame))
    kept = [(r[0], clean(r[1] or "", markov), r[3]) for r in kept]
    ref = tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=byte_bpe.read_ranks(queries.vocabulary("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = {t: ref.encode_ordinary(t) for t in {r[1] for r in kept}}
    return collections.Counter((r[0], r[2], tuple(ids[r[1]])) for r, _ in mixed(kept, corpus_pipeline.MAX_REPEATS))


def told(rows):
    assert all(r.n_tokens == len(r.ids) for r in rows)
    return collections.Counter((r.doc_id, r.source, tuple(r.ids)) for r in rows)


def test_pipeline(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(corpus_pipeline.COLUMNS).collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    assert told(corpus_pipeline.run(spark, sf).collect()) == brute(spark, docs, labels)


def test_mixed_order_lasts(spark, sf):
    """In order of shard and place, the result has the order of the mixing stage, however Spark deals its files to tasks."""
    step = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = durable(stage(spark, step, sf), "step")
    mixed_rows = source_mixing.mix(step.select(corpus_pipeline.COLUMNS), max_repeats=corpus_pipeline.MAX_REPEATS)
    want = [r.doc_id for r in mixed_rows.orderBy("epoch", "order_key").select("doc_id").collect()]
    got = corpus_pipeline.run(spark, sf).repartition(7).orderBy("shard", "place").select("doc_id").collect()
    assert [r.doc_id for r in got] == want and len(want) > 50
    frame = spark.createDataFrame([tuple(r) for r in step.limit(3).collect()], step.schema)  # not read from files
    assert corpus_pipeline.encoding(spark, frame, sf).where("shard is null and place is null").count() == 3


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The sample with rows of nulls, empty and long texts, copies, repeated ids and columns named like internal ones."""
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(corpus_pipeline.COLUMNS)
    some = docs.orderBy("doc_id").limit(40)
    secret = "token = 'abcdefghijklmnop1234' and qV9xZ2mK8pL4tR7wB3nJ6yH1cF5dG0sA stand in this quite ordinary line of plain words."
    rows = [(None, None, None, None, None), (None, "", "en", "a", 0), (9001, "", None, "a", 0), (9002, None, "en", None, None), (9003, secret, "en", "a", 1), (9003, secret, "en", "a", 1), (9004, secret, "de", "b", 1), (9005, "plain words that go on " * 4000, "en", "b", 9), (None, secret, "en", "b", 2), (9001, "another text of the same id, in a few plain words.", "en", "b", 3)]
    more = spark.createDataFrame(rows, docs.schema)
    every = docs.unionByName(some).unionByName(more)
    every.withColumns({"epoch": F.lit("x"), "rid": F.lit(1), "score": F.lit(0.5), "key": F.lit("k"), "kept_0": F.lit(0), "mark": F.lit(3)}).write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    labels.unionByName(spark.createDataFrame([(None, 1, 0), (9003, None, 0), (9004, 7, 0), (9005, 1, 0), (9005, 1, 0)], labels.schema)).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_of_odd_rows(spark, odd):
    docs = [tuple(r) for r in spark.read.parquet(f"{odd}/documents.parquet").select(corpus_pipeline.COLUMNS).collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{odd}/labels.parquet").select("doc_id", "quality").collect()]
    frames = []
    step = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, odd)
        frames.append(step.columns)
    assert frames == [corpus_pipeline.COLUMNS] * 4
    assert told(corpus_pipeline.run(spark, odd).collect()) == brute(spark, docs, labels)


def test_pipeline_of_nothing(spark, odd, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
