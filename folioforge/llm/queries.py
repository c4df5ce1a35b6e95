"""The queries op1 to op10 over the input tables: thin digests of what the operators return."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_polytope, byte_bpe, exact_dedup, importance, media_ogg, ngram_join, passage_chains, quality_rank, secret_scan, source_mixing, token_cache, url_templates, valid_time
from .shared import drop, durable_dir, table


def vocabulary(name: str) -> bytes:
    """A public tokenizer's file, read on the driver; executors get its bytes."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_join.ngram_join(table(spark, sf_dir, "documents"), count=True)
    return members.select("doc_id", "n_shingles", "component_id", "n_links", "n_texts")


def op2_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_ogg.ogg_media(table(spark, sf_dir, "documents"))
    got = F.col("got")
    feature = F.concat_ws(
        ";", *(F.concat(F.lit(f"{name}="), got[name].cast("string")) for name in ("streams", "pages", "packets", "bad_pages", "lost_packets", "duration_s", "mean", "rms", "crossings"))
    )
    return media.select(
        "doc_id", got["n_bytes"].alias("n_bytes"), F.octet_length(got["payload"]).cast("bigint").alias("payload_bytes"), F.sha2(got["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(got["payload"], -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def _equals(k: int):
    return lambda x: x == k


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = secret_scan.secret_spans(docs, secret_scan.train(secret_scan.samples_of(docs)))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    every = F.array_sort(F.concat("base", "added"))
    return spans.select("doc_id", *counts, F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"), secret_scan.spans_text(every).alias("spans"))


#: The rules of op4, in the contract's order.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # A page's last number is the id of the document that it shows, whose quality label marks its URL.
    number = F.try_element_at(F.regexp_extract_all(url_templates.path_of(pages["url"]), F.lit("[0-9]{1,18}"), F.lit(0)), F.lit(-1)).cast("bigint")
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label"))
    labelled = pages.select("url", number.alias("doc_id")).join(marks, "doc_id").select("url", "label")
    return url_templates.url_filter(pages, RULES, labelled).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_counts(table(spark, sf_dir, "documents"), max_repeats=4.0).withColumn("weight", F.round("weight", 9))


def op5_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_rank.train(docs, labels.where(~quality_rank.held_out(F.col("doc_id"))))
    scored = quality_rank.quality_scores(docs, model)
    return scored.select("doc_id", quality_rank.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern(), memo=byte_bpe.LARGE_MEMO)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_ann_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_polytope.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_chains.repeated(table(spark, sf_dir, "documents"))


def op10_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{durable_dir(spark)}/folioforge/token-counts-{uuid.uuid4().hex}"  # a cold cache: the query must not depend on earlier runs
    counts = token_cache.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), cache, normal=token_cache.folded)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table comes as two loads, the lesser half of the ids first, so that the second meets a history.
    rows = exact_dedup.digests(table(spark, sf_dir, "documents"))
    middle = rows.agg(F.percentile_approx("doc_id", 0.5).alias("m")).first().m
    older = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    found, index = exact_dedup.exact_groups([rows.where(older), rows.where(~older)], exact_dedup.DigestIndex(spark))
    drop(rows, index.table)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_time.enriched(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_media_ogg": op2_media_ogg,
    "op3_secret_scan": op3_secret_scan,
    "op4_url_templates": op4_url_templates,
    "op6_source_mixing": op6_source_mixing,
    "op5_quality_rank": op5_quality_rank,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_ann_polytope": op8_ann_polytope,
    "op9_passage_chains": op9_passage_chains,
    "op10_token_cache": op10_token_cache,
    "op11_importance": op11_importance,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_valid_time": op13_valid_time,
}

#: Op6 in SQL: with a limit on repeats alone the exponent has a closed form, where the operator bisects.
OP6 = """
with words as (
  select doc_id, source, coalesce('=' || source, 'null') as source_key, coalesce('=' || cast(doc_id as varchar), md5(coalesce(text, ''))) as key,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) as bigint) as n_tokens
  from documents),
totals as (select source_key, cast(sum(n_tokens) as double) as t, count(*) as n from words group by 1),
ends as (select max(t) as most, min(t) as least from totals where t > 0),
exponent as (select case when most / least <= 4 then 0.0 else 1 - ln(4.0) / ln(most / least) end as a from ends),
raised as (select source_key, t, n, case when t > 0 then pow(t / most, a) else 0.0 end as x from totals, ends, exponent),
weighed as (select source_key, t, n, x / (select sum(x) from raised) as weight from raised),
used as (select *, case when t > 0 then (weight / t) / (select min(weight / t) from weighed where t > 0) else 1.0 end as r from weighed),
plan as (select source_key, weight, cast(floor(r + 1e-9) as bigint) as whole, greatest(0.0, r - floor(r + 1e-9)) as part, greatest(1, cast(ceil((t + n) / 1000000.0) as bigint)) as blocks from used),
placed as (
  select w.*, p.weight, p.whole, p.part, cast(cast('0x' || substr(md5(key || ':0:block'), 1, 15) as bigint) % p.blocks as int) as block,
    cast('0x' || substr(md5(key || ':0'), 1, 15) as bigint) as place
  from words w join plan p using (source_key)),
ids as (select source_key, block, place, key, part, sum(n_tokens) as n from placed where part > 0 group by all),
summed as (select *, sum(n) over (partition by source_key, block order by place, key rows unbounded preceding) as so_far, sum(n) over (partition by source_key, block) as total from ids),
cutoffs as (select source_key, block, max(place) as cutoff from summed where so_far - n / 2.0 <= part * total group by 1, 2),
copied as (select p.*, p.whole + case when p.place <= c.cutoff then 1 else 0 end as copies from placed p left join cutoffs c using (source_key, block))
select doc_id, source, n_tokens, cast(e as int) as epoch, block, cast('0x' || substr(md5(key || ':0:' || e), 1, 15) as bigint) as order_key, round(weight, 9) as weight
from (select *, unnest(range(1, copies + 1)) as e from copied)
"""

#: Op11 in SQL, with CRC-32 byte by byte over the distinct words. The numbers are the checksum's polynomial and its table's size.
OP11 = r"""
with crc as (
  select list(list_reduce(list_prepend(i, range(1, 9)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) r(i)),
texts as (
  select 'd' as side, doc_id as id, row_number() over () as row, coalesce(text, '') as text from documents
  union all select 'b', item_id, row_number() over (), coalesce(text, '') from benchmark),
words as (
  select side, id, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
each_ as (select side, row, unnest(w) as w from words),
distinct_ as (select distinct w, hex(encode(w)) as h from each_),
hashed as (
  select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(cast(len(h) / 2 as bigint)), lambda i: cast(('0x' || substr(h, 2 * i + 1, 2)) as bigint))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 as bucket
  from distinct_, crc),
counted as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from each_ join hashed using (w) group by 1),
whole as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from counted),
gains as (select bucket, cast(floor(1000 * ln(cast(t + 1 as double) * (s_all + 10000) / (cast(s + 1 as double) * (t_all + 10000)))) as bigint) as gain from counted, whole),
weights as (select row, sum(gain) as weight from each_ join hashed using (w) join gains using (bucket) where side = 'd' group by 1),
scored as (
  select id as doc_id, cast(len(w) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(id as varchar), 'null')), 1, 8) as bigint) + 0.5) / 4294967296))) as bigint) as score
  from words left join weights using (row) where side = 'd'),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) as place, count(*) filter (n_features >= 20) over () as n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= n * 10 // 100 then place end as rank from placed
"""

OP12 = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

#: Op13 in SQL: instead of a state, versions that a batch holds are found from the batches in which they came and were pruned.
OP13 = """
with crc as (
  select list(list_reduce(list_prepend(i, range(1, 9)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) r(i)),
changes as (
  select c.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(cast(change_id as varchar))), lambda i: cast(ascii(substr(cast(change_id as varchar), i + 1, 1)) as bigint))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 4 as delay
  from (select distinct * from client_changes where valid_at is not null) c, crc),
versions as (
  select client_id, change_id, valid_at, op, cast(floor(100 * balance + 0.5) as bigint) as cents,
    greatest(0, coalesce(least(11, cast(floor((date_diff('day', date '1970-01-01', cast(valid_at as date)) + delay - 19723) * 12 / 152) as bigint)), 11)) as b
  from changes),
sold as (
  select row_number() over () as n, sale_id, client_id, sold_at,
    greatest(0, coalesce(least(11, cast(floor((date_diff('day', date '1970-01-01', cast(arrived_at as date)) - 19723) * 12 / 152) as bigint)), 11)) as b
  from sales),
maxima as (select e, (select max(sold_at) from sold where b < e) as ws, (select max(valid_at) from versions where b < e) as wc from range(13) r(e)),
marks as (select e, wc, case when ws is not null and wc is not null then least(ws, wc) end as h from maxima),
late as (select v.* from versions v join marks m on m.e = v.b where v.valid_at < m.wc),
taken as (
  select v.*, row_number() over (partition by client_id order by valid_at, change_id nulls first, cents nulls first, op nulls first) as o
  from versions v join marks m on m.e = v.b where v.client_id is not null and (m.wc is null or v.valid_at >= m.wc)),
kept as (select m.e, v.client_id, max(o) as o from marks m join taken v on v.b <= m.e and v.valid_at <= m.h where m.e < 12 group by all),
held as (
  select m.e, v.* from marks m join taken v on v.b <= m.e left join kept k on k.e = m.e - 1 and k.client_id = v.client_id
  where v.b = m.e or v.o >= coalesce(k.o, 0)),
sizes as (select e, client_id, count(*) as n_held from held group by all),
gone as (select s.*, coalesce((select min(m.e) from marks m where m.e >= s.b and m.e < 12 and (s.sold_at is null or s.sold_at < m.h)), 12) as e from sold s),
chosen as (select g.n, max(h.o) as o from gone g join held h on h.client_id = g.client_id and h.e = g.e and h.valid_at <= g.sold_at group by all)
select 'sale' as rec, g.sale_id as id, cast(g.e as bigint) as batch, cast(coalesce(n_held, 0) as bigint) as n_held, v.change_id, v.cents as balance_cents, v.op
from gone g left join sizes z on z.e = g.e and z.client_id = g.client_id left join chosen c on c.n = g.n left join taken v on v.client_id = g.client_id and v.o = c.o
union all select 'late', change_id, cast(b as bigint), null, null, null, null from late
"""

ORACLES: dict[str, str] = {"op6_source_mixing": OP6, "op11_importance": OP11, "op12_exact_dedup": OP12, "op13_valid_time": OP13}
