"""Operators that compare rows: near duplicates, URL templates, mixing, neighbours, passages; and the pipeline."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import ann_polytope, components, ngram_join, passage_chains, queries, shared_keys, source_mixing, url_templates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    """Row number to the least id of its component, by comparing all rows that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, o in collections.Counter(j for g in s for j in held[g] if j > i).items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                parent[find(j)] = find(i)
    least = {}
    brute_components.links = [0] * len(rows)  # of each row to others
    brute_components.texts = [set() for _ in rows]
    for i, s in enumerate(sets):
        for j, o in collections.Counter(j for g in s for j in held[g] if j != i).items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                brute_components.links[i] += 1
                if s != sets[j]:
                    brute_components.texts[i].add(frozenset(sets[j]))
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def edited(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_ngram_join_brute(spark, monkeypatch):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (60, 200, 700, 1200)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [edited(rng, b, rng.randrange(0, max(2, len(b.split()) // 25))) for b in base for _ in range(25)]
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 200))) for _ in range(80)]
    texts += ["", None, " \n ", "one two", "One  two", "one two three four five", "ONE two three four five", "x " * 3000, "x " * 2500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (1000, texts[30])]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, rid int, n int")
    for tile in (1024, 8):  # small tiles: several for each block, and for each component
        monkeypatch.setattr(ngram_join, "COUNT_SETS", tile)
        members, links = ngram_join.ngram_join(docs, tile=tile, count=True)
        got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.n_links, r.n_texts) for r in members.collect())))
        brute = brute_components(rows)
        assert got == sorted(map(str, ((*b, n, len(t)) for b, n, t in zip(brute, brute_components.links, brute_components.texts, strict=True))))
        assert links.where("a = b").count() == 0


def test_ngram_join_edges(spark, sf):
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id bigint, text string"))[0].count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "A b c d e f", "t"), (3, None, "u"), (4, "", "v"), (None, "a b c d e f", "w")], "doc_id bigint, text string, source string")
    kept = ngram_join.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "None"] and len(kept[0]) == 3


def test_op1(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in queries.op1_ngram_join(spark, sf).collect())
    assert got == sorted((*b, n) for b, n in zip(brute_components(docs), brute_components.links, strict=True))


def test_possible_overlap_is_a_bound():
    rng = np.random.default_rng(0)
    for n in (5, 300, 3000):
        pool = np.sort(rng.integers(0, 1 << 63, n * 2, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool, n, replace=False)) for _ in range(2))
        x, y = ngram_join.bitmap(a)[None], ngram_join.bitmap(b)[None]
        assert ngram_join.possible_overlap(x, y, np.array([n]), np.array([n]))[0] >= ngram_join.common(a, b) == len(np.intersect1d(a, b))
        assert (ngram_join.folded(ngram_join.bitmap(a, 3), ngram_join.BITS // 64) == ngram_join.bitmap(a, 0)).all()


def test_shared_keys_brute(spark, monkeypatch):
    """Keys with several owners, whatever the tasks and buckets; hot keys go on beside their bucket."""
    rng = random.Random(23)
    edge = [0, 1, (1 << 64) - 1, (1 << 63), (1 << 63) - 1]
    rows = [(rng.choice(edge) if rng.random() < 0.02 else rng.randrange(3000) * 6148914691236517 % (1 << 64), rng.randrange(400) - 200, i) for i in range(6000)]
    rows += [(7, rng.randrange(5000), i) for i in range(3000)] + [(8, 1, i) for i in range(500)]
    owners = collections.defaultdict(set)
    for key, owner, _ in rows:
        owners[key].add(owner)
    signed = lambda k: k - (1 << 64) if k >= 1 << 63 else k
    expected = sorted((signed(k), o, v) for k, o, v in rows if len(owners[k]) > 1)
    df = spark.createDataFrame([(signed(k), o, v) for k, o, v in rows], "k bigint, o bigint, v bigint").repartition(6)
    read = lambda b: (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), *(b.column(n).to_numpy(zero_copy_only=False) for n in (1, 2)))
    got = shared_keys.shared_keys(df, read, ["key", "owner", "value"], len(rows))
    assert sorted(map(tuple, got.collect())) == expected
    assert shared_keys.shared_keys(df.limit(0), read, ["key", "owner", "value"], 0).count() == 0
    key, owner = np.full(1000, 7, np.uint64), np.arange(1000)
    packed = list(shared_keys._cut((key, owner), 16))
    assert sum(len(b.column(2)[0].as_py()) // 8 for b in packed if not b.column(1)[0].as_py()) == 2


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1]}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# URLs


def test_op4_rules(spark):
    urls = ["http://Example.com/en/1", "https://www.example.com/en/2", "http://a.net/es/3?x", "http://net/fr/", "http://a.com", "http://a.com?q=/en/", "nothing", None, "x://y://z/en/#f", "http://example.org/en/5"]
    pages = spark.createDataFrame([(i, u, 1, "v") for i, u in enumerate(urls)], "page_id bigint, url string, host int, verdict string")
    got = url_templates.url_filter(pages, queries.RULES).orderBy("page_id").collect()
    assert [r.rule for r in got] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, None]
    assert [r.verdict for r in got] == ["block", "allow", "block", "block"] + ["allow"] * 6
    assert [(r.host, r.path) for r in got][4:9] == [("a.com", ""), ("a.com", ""), ("", ""), ("", ""), ("y:", "//z/en/")]
    assert url_templates.url_filter(pages.limit(0), queries.RULES).count() == 0


def test_templates_and_purity(spark):
    rows = [(f"http://h.org/good/{i}", 1) for i in range(60)] + [(f"http://h.org/bad/{i}.html", 0) for i in range(60)] + [(f"http://h.org/mixed/{i}", i % 2) for i in range(10)]
    labels = spark.createDataFrame(rows, "url string, label int")
    pages = spark.createDataFrame([(1, "http://h.org/good/777"), (2, "http://h.org/bad/888.html"), (3, "http://new.org/x")], "page_id bigint, url string")
    got = {r.page_id: r for r in url_templates.url_filter(pages, [], labels).collect()}
    assert got[1].template == "/good/#" and got[2].template == "/bad/#.html"
    assert (got[1].verdict, got[2].verdict, got[3].verdict) == ("allow", "block", "allow")


def brute_tree(urls):
    """(host, path) to (template, branch, verdict); urls: (host, path) to [n, good, labelled]."""
    t = url_templates
    good, known = (sum(u[k] for u in urls.values()) for k in (1, 2))
    prior = good / known if known else 1.0

    def differs(a, b, pool_a, pool_b):
        rate = (pool_a + t.WEIGHT * prior) / (pool_b + t.WEIGHT)
        return b > 0 and abs(a / b - rate) > t.APART * math.sqrt(max(rate * (1 - rate), 1e-6) / b)

    def add(into, key, u):
        into.setdefault(key, [0, 0, 0])
        into[key] = [x + y for x, y in zip(into[key], u, strict=True)]

    parts, steps = {}, {}
    for key in urls:
        p = [s for s in key[1].split("/") if s]
        parts[key], steps[key] = (p[: t.LEVELS - 1] + ["/".join(p[t.LEVELS - 1 :])] if len(p) > t.LEVELS else p), ()
    for level in range(max(map(len, parts.values()), default=0)):
        node, raw, form = {}, {}, {}
        live = [k for k in urls if len(parts[k]) > level]
        for k in live:
            s = parts[k][level]
            add(node, (k[0], steps[k]), urls[k])
            add(raw, (k[0], steps[k], s), urls[k])
            add(form, (k[0], steps[k], re.sub("[0-9]+", "#", s)), urls[k])

        def stays(table, key):
            n, a, b = table[key]
            all_n, all_a, all_b = node[key[:2]]
            return n >= t.MIN_COUNT and (n >= all_n * t.SHARE or b >= t.MIN_COUNT and differs(a, b, all_a, all_b))

        for k in live:
            s, at = parts[k][level], (k[0], steps[k])
            f = re.sub("[0-9]+", "#", s)
            steps[k] += (s if stays(raw, (*at, s)) else f if stays(form, (*at, f)) else "*",)
    nodes, alone = {}, {}
    for k, u in urls.items():
        add(nodes, (k[0], steps[k]), u)
    for depth in range(max(map(len, steps.values()), default=0), 0, -1):
        pool = {}
        for (host, st), u in nodes.items():
            if len(st) in (depth, depth - 1):
                add(pool, (host, st[: depth - 1]), u)
        for (host, st), u in [x for x in nodes.items() if len(x[0][1]) == depth]:
            if differs(u[1], u[2], *pool[host, st[:-1]][1:]):
                alone[host, st] = u
            else:
                add(nodes, (host, st[:-1]), u)
    alone |= {k: u for k, u in nodes.items() if not k[1]}
    out = {}
    for k in urls:
        branch = max((st for host, st in alone if host == k[0] and steps[k][: len(st)] == st), key=len, default=())
        _, a, b = alone.get((k[0], branch), (0, 0, 0))
        text = lambda st: "".join("/" + s for s in st)
        out[k] = (text(steps[k]), text(branch), "block" if (a + t.WEIGHT * prior) / (b + t.WEIGHT) < t.REJECT_BELOW else "allow")
    return out


def split_url(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else None
    host = re.split("[/?#]", rest, maxsplit=1)[0] if rest is not None else ""
    return host.translate(LOWER), re.split("[?#]", (rest or "")[len(host) :], maxsplit=1)[0]


def urls_of(pages, labels):
    urls = collections.defaultdict(lambda: [0, 0, 0])
    for url in pages:
        urls[split_url(url)][0] += 1
    for url, label in labels:
        urls[split_url(url)][1] += label == 1
        urls[split_url(url)][2] += label in (0, 1)
    return {k: [max(n, b), a, b] for k, (n, a, b) in urls.items()}


def test_tree_brute(spark):
    rng = random.Random(17)
    pages, labels = [], []
    for i in range(3000):
        host = rng.choice(["a.org", "B.org:80", "c.net"])
        section = rng.choice(["news", "shop", "blog/x/y", "forum/t", f"u{rng.randrange(400)}", "", f"deep/{'/'.join('abcdefgh')}"])
        leaf = rng.choice(["good/1", "bad/2", f"p{i}.html", f"{i}", "index", f"{rng.randrange(3)}/{i}/x"])
        url = f"http://{host}/{section}/{leaf}" + rng.choice(["", "?q=/x", "#f"])
        pages.append(url)
        if rng.random() < 0.5:
            poor = "bad" in leaf or section == "shop" or (host == "c.net" and "deep" in section)
            labels.append((url, int(rng.random() < (0.1 if poor else 0.9))))
    pages += ["http://trap.org" + "/a" * 40 + f"/{i}" for i in range(12)] + ["nothing", None, "http://few.org/1/2/3", "http://few.org"]
    labels += [("http://trap.org" + "/a" * 40 + "/3", 0), ("http://other.org/x", 0), (pages[0], None), (pages[1], 5)]
    brute = brute_tree(urls_of(pages, labels))
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, url string")
    got = url_templates.url_filter(frame, [], spark.createDataFrame(labels, "url string, label int")).collect()
    assert {r.page_id: ((r.host, r.path), (r.template, r.branch, r.verdict)) for r in got} == {i: (split_url(u), brute[split_url(u)]) for i, u in enumerate(pages)}
    assert {r.verdict for r in got} == {"allow", "block"}


def test_deep_paths_are_told_apart(spark):
    """Labels that only the fourth of five segments explains."""
    rows = [(f"http://h.org/a/b/c/{kind}/{i}", int(kind == "good")) for i in range(200) for kind in ("good", "bad")]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_templates.url_filter(pages, [], spark.createDataFrame(rows, "url string, label int")).collect()}
    assert all(got[i] == ("allow" if good else "block") for i, (_, good) in enumerate(rows))
    assert got and url_templates.url_filter(pages.limit(0), [], None).count() == 0


def test_op4(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    labels = [(r.url, marks.get(int(n[-1]) if (n := re.findall("[0-9]{1,18}", split_url(r.url)[1])) else None)) for r in pages]
    brute = brute_tree(urls_of([r.url for r in pages], [x for x in labels if x[1] in (0, 1)]))
    for r in queries.op4_url_templates(spark, sf).collect():
        url = next(p.url for p in pages if p.page_id == r.page_id)
        host, path = split_url(url)
        fits = [(what, rule) for what, rule in queries.RULES if (host == (h := rule.partition("/")[0]) or host.endswith("." + h)) and path.startswith(rule[len(h) :])]
        what, rule = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert (r.host, r.path, r.rule, r.verdict, r.template) == (host, path, rule, what or brute[host, path][2], brute[host, path][0])


# Mixing


def test_exponent():
    tokens = [1000.0, 100.0, 10.0]
    a = source_mixing.exponent(tokens, max_repeats=4.0)
    assert max(source_mixing.repeats(tokens, source_mixing.weights(tokens, a), None)) == pytest.approx(4.0)
    a = source_mixing.exponent(tokens, target_entropy=0.9)
    assert source_mixing.entropy(source_mixing.weights(tokens, a)) == pytest.approx(0.9)
    assert source_mixing.exponent(tokens) == 1.0 and source_mixing.exponent([5.0, 5.0], max_repeats=2.0) == 0.0


def test_mix(spark):
    rows = [(i, "a b c d", "big") for i in range(600)] + [(1000 + i, "a b c d e", "small") for i in range(100)] + [(5000, None, None), (None, "", "small"), (7, "a b c d", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("epoch", F.lit("mine"))
    got = source_mixing.mix(docs, max_repeats=3.5, block_tokens=100).collect()
    n = collections.Counter(r.source for r in got)
    tokens = {"big": 2404, "small": 500}
    w = source_mixing.weights(list(tokens.values()), 0)
    expected = dict(zip(tokens, source_mixing.repeats(list(tokens.values()), source_mixing.weights(list(tokens.values()), source_mixing.exponent(list(tokens.values()), max_repeats=3.5)), None), strict=True))
    assert w == [0.5, 0.5] and n["big"] == 601 and n["small"] / 101 == pytest.approx(expected["small"], rel=0.1) and n[None] >= 1
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert source_mixing.mix(docs.limit(0), max_repeats=2.0).count() == 0
    again = source_mixing.mix(docs, max_repeats=3.5, block_tokens=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_keeps_columns_and_spreads(spark):
    """Columns named as internal or added ones; rows without ids and empty texts don't meet in one block."""
    rows = [(None, f"text number {i}", "s", i, "e", "b", i, i) for i in range(300)] + [(i, "", "empty", i, "e", "b", i, i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_id int, epoch string, block string, key int, tokens int")
    got = source_mixing.mix(docs, max_repeats=2.0, block_tokens=50).collect()
    assert got[0].asDict().keys() == {*docs.columns, "epoch_mix", "block_mix", "order_key", "weight"}
    assert {r.mix_id for r in got if r.source == "s"} == set(range(300)) == {r.mix_id for r in got if r.source == "empty"}
    blocks = collections.Counter((r.source, r.block_mix) for r in got)
    assert len({b for s, b in blocks if s == "s"}) > 15 and len({b for s, b in blocks if s == "empty"}) > 4
    assert source_mixing.added_names(["weight", "weight_mix"])[-1] == "weight_mix_mix"


def same_rows(df, sql, sf):
    """Whether DuckDB gives df's rows."""
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "sales", "client_changes"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    result = con.execute(sql)
    names = sorted(d[0] for d in result.description)
    told = lambda rows, at: sorted(str([f"{v:.6f}" if isinstance(v, float) else v for v in (r[at[c]] for c in names)]) for r in rows)
    assert names == sorted(df.columns)
    return told([tuple(r) for r in df.collect()], {c: df.columns.index(c) for c in names}) == told(result.fetchall(), {d[0]: i for i, d in enumerate(result.description)})


def test_op6_sql(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        assert same_rows(queries.op6_source_mixing(spark, d), queries.ORACLES["op6_source_mixing"], d)


# Neighbours


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(400, x[0].tolist(), 1), (401, None, 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [None] * 16, 1), (None, x[1].tolist(), 1), (0, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    whole = np.vstack((x, x[:1])).astype(np.float64)
    for chunk, queries_at_once in ((16384, 4096), (7, 5)):
        got = collections.defaultdict(list)
        found = ann_polytope.nearest(df, F.col("id") % 20 == 0, k=5, tables=3, probes=1.0, chunk=chunk, chunk_queries=queries_at_once)  # all axes: exact
        for r in found.orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == set(range(0, 401, 20))
        for q, hits in got.items():
            s = whole @ whole[q]
            order = sorted((i for i in range(401) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
            assert [v for v, _ in hits] == order and all(math.isclose(c, s[v], abs_tol=1e-12) for v, c in hits)
    assert ann_polytope.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def brute_nearest(x, ids, k):
    """(query, vector) pairs of the k nearest, ties to the smaller id."""
    out = set()
    for i in (i for i, v in enumerate(ids) if v % 20 == 0):
        score = x @ x[i]
        out |= {(ids[i], ids[j]) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-score[j], ids[j]))[:k]}
    return out


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_op8_recall(spark, sf_dir):
    rows = queries.op8_ann_polytope(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    m, ids = np.array([r.embedding for r in table], np.float64), [r.vec_id for r in table]
    true = brute_nearest(m, ids, 20)
    at = {v: i for i, v in enumerate(ids)}
    assert len(true & {(r.query_id, r.vec_id) for r in rows}) / len(true) >= 0.9
    assert len(rows) == len(true) and all(r.score == pytest.approx(m[at[r.query_id]] @ m[at[r.vec_id]], abs=1e-12) for r in rows)
    # Pairs scored, as a share of all: below brute force, and each once.
    found = [ann_polytope.axes(m, t, n) for n in (1, int(np.ceil(ann_polytope.PROBES * 128))) for t in range(ann_polytope.TABLES)]
    points, asked = np.concatenate(found[: ann_polytope.TABLES], 1), np.concatenate(found[ann_polytope.TABLES :], 1)[[i for i, v in enumerate(ids) if v % 20 == 0]]
    met = [ann_polytope.probed(points, asked, t) for t in range(ann_polytope.TABLES)]
    assert not (met[0] & met[1]).any() and np.mean(met[0] | met[1]) < 0.75


def test_nearest_of_unequal_lengths_and_few(spark):
    """Inner products favour long vectors; a query whose buckets hold too little is asked again over all."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16)) * rng.lognormal(sigma=1.0, size=(600, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann_polytope.nearest(df, F.col("id") % 20 == 0).collect()}
    true = brute_nearest(x, list(range(600)), 20)
    assert len(got) == len(true) and len(true & got) / len(true) >= 0.9
    # All but the queries stand in one direction, away from them.
    y = np.tile([1.0] + [0.0] * 15, (60, 1)) + rng.normal(size=(60, 16)) * 0.01
    y[::20] = [-1.0] + [0.0] * 15
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id bigint, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in ann_polytope.nearest(df, F.col("id") % 20 == 0, probes=0.1).collect()} == brute_nearest(y, list(range(60)), 20)


# Passages


def test_chains():
    anchors = [(0, 10), (5, 15), (9, 19), (200, 3), (205, 8), (7, 400)]
    assert passage_chains.chains(anchors)[0] == [(0, 10), (5, 15), (9, 19)]

    def best(points, i):
        x, y = points[i]
        return max([7.0] + [7 + best(points, j) - 0.05 * (x - points[j][0] + y - points[j][1]) for j in range(len(points)) if points[j][0] < x and points[j][1] < y])

    rng = random.Random(1)
    for _ in range(20):
        points = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(10)})
        chain = passage_chains.chains(points)[0]
        score = 7 * len(chain) - 0.05 * (chain[-1][0] - chain[0][0] + chain[-1][1] - chain[0][1])
        assert score == pytest.approx(max(best(points, i) for i in range(len(points))))


def test_passages(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage, line = fresh(60), fresh(12)
    fuzzy = [*passage[:30], "changed", *passage[31:]]
    texts = {1: fresh(100) + passage + fresh(50), 2: fresh(10) + fuzzy + fresh(80), 3: fresh(200) + line, 4: line + fresh(100), 5: fresh(70), 6: None, 7: ["x"] * 80, 8: [*fresh(20), *["x"] * 70], 9: fresh(20), 10: ""}
    rows = [(i, " ".join(t) if isinstance(t, list) else t) for i, t in texts.items()]
    rows += [(11, " ".join(texts[5])), (12, " ".join(texts[9])), (None, " ".join(texts[5])), (5, " ".join(texts[5]))]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, tid int")
    got = {r.doc_id: r for r in passage_chains.repeated(docs).collect()}
    assert set(got) == {1, 2, 5, 7, 8, 11}
    assert got[1].spans == "100:160" and got[2].spans == "10:70" and got[1].partner_id == 2 and got[5].spans == "0:70"
    assert got[11].partner_id == 5 and passage_chains.repeated(docs.limit(0)).count() == 0


def test_passages_behind_long_edits(spark):
    """Replaced, inserted and deleted stretches of 7 to 14 words end no passage behind them; the shorter part is bridged where the whole is alike enough."""
    rng = random.Random(21)
    fresh = lambda n: [f"v{rng.randrange(10**8)}" for _ in range(n)]
    parts = [fresh(n) for n in (30, 300, 60, 300, 40, 40, 100)]
    a = [*parts[0], *fresh(10), *parts[1]]
    b = [*parts[0], *fresh(10), *parts[1]]
    c = [*parts[2], *fresh(9), *parts[3]]
    d = [*parts[2], *parts[3]]
    e = [*parts[4], *fresh(10), *parts[5]]
    f = [*parts[4], *fresh(10), *parts[5]]
    g = [*parts[6], *(w for i in range(14) for w in [*fresh(3), f"z{i}", f"zz{i}", f"zzz{i}"])]
    h = [*parts[6], *(w for i in range(14) for w in [*fresh(3), f"z{i}", f"zz{i}", f"zzz{i}"])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((a, b, c, d, e, f, g, h))], "doc_id bigint, text string")
    got = {r.doc_id: [tuple(map(int, s.split(":"))) for s in r.spans.split(",")] for r in passage_chains.repeated(docs).collect()}
    assert got[0] == got[1] == [(0, 340)] and got[2] == [(0, 369)] and got[3] == [(0, 360)]
    assert got[4] == got[5] == [(0, 90)]
    assert got[6] == got[7] and got[6][0][0] == 0 and 100 <= got[6][0][1] < 160


def spans_of(row):
    return [tuple(map(int, s.split(":"))) for s in row.spans.split(",")]


def uncovered(rows, got):
    """Runs of 50 words that two different texts share and a span doesn't cover: (doc, start)."""
    held = collections.defaultdict(set)
    texts = [tuple(words(t)) for _, t in rows]
    for n, w in enumerate(texts):
        for i in range(len(w) - 49):
            held[w[i : i + 50]].add(w)
    return [(d, i) for (d, _), w in zip(rows, texts, strict=True) if d is not None for i in range(len(w) - 49) if len(held[w[i : i + 50]]) > 1 and not any(a <= i and i + 50 <= z for a, z in got.get(d, []))]


def test_passages_whose_parts_stand_elsewhere(spark):
    """Many texts hold parts of a passage that two share whole: pieces of 16 words, and its halves of 30."""
    rng = random.Random(31)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage, halves = fresh(60), (fresh(30), fresh(30))
    texts = {1000: fresh(80) + passage + fresh(40), 1001: fresh(30) + passage + fresh(90), 1002: fresh(60) + halves[0] + halves[1] + fresh(60), 1003: fresh(50) + halves[0] + halves[1]}
    for i in range(300):
        at = rng.randrange(0, 45)
        texts[i] = fresh(40) + passage[at : at + 16] + fresh(20)
    for i in range(300, 600):
        texts[i] = fresh(40) + halves[i % 2] + fresh(30)
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    rng.shuffle(rows)
    got = {r.doc_id: spans_of(r) for r in passage_chains.repeated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert not uncovered(rows, got) and {1000, 1001, 1002, 1003} <= set(got)
    assert got[1000] == [(80, 140)] and got[1001] == [(30, 90)] and got[1002] == [(60, 120)]


@pytest.mark.parametrize(("length", "every", "piece"), [(300, 25, 30), (120, 20, 30), (200, 15, 25), (80, 25, 20)])
def test_edited_passages_whose_parts_stand_elsewhere(spark, length, every, piece):
    """Pairs of texts share a passage with one word in `every` replaced in the second; 200 others for each pair hold pieces of it."""
    rng = random.Random(length)
    fresh = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    texts, found = {}, 0
    for no in range(10):
        passage = fresh(length)
        second = [f"e{rng.randrange(10**8)}" if rng.random() < 1 / every else w for w in passage]
        texts[10000 + 2 * no], texts[10001 + 2 * no] = fresh(100) + passage + fresh(50), fresh(60) + second + fresh(80)
        for i in range(200):
            at = rng.randrange(0, length - piece + 1)
            texts[no * 200 + i] = fresh(30) + passage[at : at + piece] + fresh(30)
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    got = {r.doc_id: spans_of(r) for r in passage_chains.repeated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    for no in range(10):
        covered = sum(z - a for a, z in got.get(10000 + 2 * no, []) if 95 <= a and z <= 105 + length)
        found += covered >= 0.8 * length
    assert found >= 9 and set(got) <= {10000 + n for n in range(20)}


def test_passages_whose_partners_are_found_already(spark):
    """Runs of 50 words whose other texts have them in longer passages, whose text has the least id and them twice, and that repeat few words; many texts hold parts of them."""
    rng = random.Random(33)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    texts = {}
    for no in range(6):
        run, private = fresh(50 + no), fresh(70)
        texts |= {1000 + 10 * no: fresh(30) + run + fresh(40) + run, 1001 + 10 * no: fresh(40) + private + run + fresh(20), 1002 + 10 * no: fresh(10) + private + run}
        for i in range(40):
            at = rng.randrange(len(run) - 24)
            texts[100 * no + i] = fresh(20) + run[at : at + 25] + fresh(30)
    for period in range(1, 10):
        few = [f"p{period}_{i}" for i in range(period)] * 300
        for n, length in enumerate((300, 60, 52)):
            texts[2000 + 10 * period + n] = fresh(period + n) + few[n : n + length] + fresh(20)
        rest = fresh(30)
        for n, length in enumerate((20, 21, 60)):
            texts[2005 + 10 * period + n] = fresh(20) + few[60 * period - length : 60 * period] + rest + fresh(20)
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    rng.shuffle(rows)
    got = {r.doc_id: spans_of(r) for r in passage_chains.repeated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert not uncovered(rows, got)
    assert not {i for i in got if i < 1000}  # parts of 25 words are no passages


def test_without_repeats(spark):
    rng = random.Random(32)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    p, a, b, c, d = fresh(70), fresh(30), fresh(40), fresh(20), fresh(60)
    first, second = " ".join(a + p) + "\n" + " ".join(b), " ".join(c + p) + " \n " + " ".join(d)
    rows = [(5, first, 1), (7, second, 2), (7, second, 2), (9, first, 3), (None, first, 4), (11, " ".join(d[:30]), 5), (12, None, 6), (13, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    got = sorted((str(r.doc_id), r.text, r.spans) for r in passage_chains.without_repeats(docs).collect())
    kept = " ".join(c) + " " + " ".join(d)
    assert got == sorted([("5", first, 1), ("7", kept, 2), ("7", kept, 2), ("9", "", 3), ("None", first, 4), ("11", " ".join(d[:30]), 5), ("12", None, 6), ("13", "", 7)])
    assert passage_chains.without_repeats(docs.limit(0)).count() == 0


def test_op9_finds_exact_passages(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert not uncovered(docs, {r.doc_id: spans_of(r) for r in queries.op9_passage_chains(spark, sf).collect()})


def test_op9_finds_documents(spark, sf):
    seen, shared = {}, set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = words(r.text)
        for i in range(len(w) - 49):
            other = seen.setdefault(tuple(w[i : i + 50]), r.doc_id)
            if other != r.doc_id:
                shared |= {other, r.doc_id}
    assert shared <= {r.doc_id for r in queries.op9_passage_chains(spark, sf).collect()}
