"""URL filters: host and path rules, and a path-template tree for what no rule covers.

The tree has, for each host, a level for each path segment. Top down, a
segment stays as it is if many of its node's URLs share it (SHARE, and MIN_COUNT of them), or if MIN_COUNT or more of its URLs are
labelled and their purity differs significantly from the node's; the others are
generalised to their shape (runs of digits to '#') where that is shared, else to
'*'. A node of fewer URLs than MIN_COUNT has wildcards below it. A level is worked out
for the paths that reach it, so the tree is as deep as they are; from level LEVELS on what is left of a path counts as one segment.

Bottom up, a branch whose labelled purity does not differ significantly (by APART standard errors) from
that of its parent's branches taken together is merged into the parent, which is
then compared in the same way. A branch that is left, or a host's root, is rejected when its smoothed
purity, (good + WEIGHT * prior) / (labelled + WEIGHT), falls below a threshold;
the prior is the purity of all labelled URLs.

Only DataFrame operations. Pages are read for their URL column only, and the tree is made of distinct URLs
with their numbers: a URL counts as often as it stands in the pages, or in the labels if that is more (labels aren't counted
on top). Each level
counts children with map-side aggregation and joins back just the shared ones, by broadcast up to BROADCAST_NODES rows, else by a
shuffle that adaptive execution splits for hot hosts; it writes only the URLs that go on. Judged branches are joined
back the same way.

Defined cases: a null URL, or one without '://', has an empty host and path; empty segments are left out; the
longest fitting rule wins; without labels every template has the prior of 1 and
is allowed; labels are 0 or 1, others and nulls are left out; repeated pages and null ids each give
a row; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, durable

#: Levels that are told apart one by one; what is left of a longer path is one segment of the last.
LEVELS = 32
#: A segment is shared if this share of its node's URLs, and MIN_COUNT of them, have it.
SHARE, MIN_COUNT = 0.02, 5
WEIGHT = 10.0
#: Standard errors by which a branch's purity must differ from its parent's to stand alone.
APART = 2.5
REJECT_BELOW = 0.5
BROADCAST_NODES = 200_000


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null where none fits); rules: (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are longer and win
        h, p = split_rule(text)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _small(df: DataFrame, limit: int = BROADCAST_NODES) -> DataFrame:
    """df, marked for broadcast if it has been counted to have at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shape(segment: Column) -> Column:
    return F.regexp_replace(segment, "[0-9]+", "#")


def differs(good: Column, labelled: Column, pool_good: Column, pool_labelled: Column, prior: float, weight: float = WEIGHT, apart: float = APART) -> Column:
    """Whether a part's purity is significantly another than that of the pool that holds it."""
    rate = (pool_good + weight * prior) / (pool_labelled + weight)
    error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-6)) / F.greatest(labelled, F.lit(1)))
    return (labelled > 0) & (F.abs(good / F.greatest(labelled, F.lit(1)) - rate) > apart * error)


def distinct_urls(pages: DataFrame, labels: DataFrame | None) -> DataFrame:
    """host, path, n (how often it counts), good, labelled of each URL; pages and labels have host and path, labels a label too."""
    zero = F.lit(0).cast("bigint")
    rows = pages.select("host", "path", F.lit(1).cast("bigint").alias("page"), zero.alias("good"), zero.alias("labelled"))
    if labels is not None:
        known = F.when(F.col("label").isin(0, 1), 1).otherwise(0).cast("bigint")
        rows = rows.unionByName(labels.select("host", "path", zero.alias("page"), F.when(F.col("label") == 1, 1).otherwise(0).cast("bigint").alias("good"), known.alias("labelled")))
    sums = rows.groupBy("host", "path").agg(F.sum("page").alias("page"), F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    return sums.select("host", "path", F.greatest("page", "labelled").alias("n"), "good", "labelled")


def add_templates(urls: DataFrame, prior: float, levels: int = LEVELS, share: float = SHARE, min_count: int = MIN_COUNT) -> DataFrame:
    """distinct_urls with steps: the generalised segments of the path."""
    parts = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    joined = F.concat(F.slice(parts, 1, levels - 1), F.array(F.array_join(F.slice(parts, levels, F.greatest(F.size(parts) - levels + 1, F.lit(1))), "/")))
    rows = urls.withColumns({"parts": F.when(F.size(parts) > levels, joined).otherwise(parts), "steps": F.array().cast("array<string>")})
    done, level = [], 0
    while True:
        level += 1
        live = durable(rows, f"level{level}")
        done.append(live.where(F.size("parts") < level).drop("parts"))
        live = live.where(F.size("parts") >= level)
        if not live.limit(1).count():
            break
        raw = F.get("parts", F.lit(level - 1))
        live = live.withColumns({"raw": raw, "form": shape(raw)})
        counts = live.groupBy("host", "steps", "form", "raw").agg(*(F.sum(c).alias(c) for c in ("n", "good", "labelled")))
        # One pass counts the node, the shapes and the segments.
        sets = [["host", "steps"], ["host", "steps", "form"], ["host", "steps", "form", "raw"]]
        sums = counts.groupingSets(sets, "host", "steps", "form", "raw").agg(*(F.sum(c).alias(c) for c in ("n", "good", "labelled")), F.grouping_id().alias("g"))
        sums = durable(sums.where(f"n >= {min_count}"), "sums")
        nodes = _small(sums.where("g = 3").select("host", "steps", *(F.col(c).alias(f"node_{c}") for c in ("n", "good", "labelled"))))
        within = sums.where("g < 3").join(nodes, ["host", "steps"])
        often = F.col("n") >= F.col("node_n") * share
        apart = (F.col("labelled") >= min_count) & differs(F.col("good"), F.col("labelled"), F.col("node_good"), F.col("node_labelled"), prior)
        literal = _small(durable(within.where((F.col("g") == 0) & (often | apart)).select("host", "steps", "raw", F.lit(True).alias("is_literal")), "literal"))
        formed = _small(durable(within.where((F.col("g") == 1) & (often | apart)).select("host", "steps", "form", F.lit(True).alias("is_form")), "form"))
        told = live.join(nodes.select("host", "steps", F.lit(True).alias("is_node")), ["host", "steps"], "left").join(literal, ["host", "steps", "raw"], "left").join(formed, ["host", "steps", "form"], "left")
        step = F.when(F.col("is_literal"), F.col("raw")).when(F.col("is_form"), F.col("form")).otherwise(F.lit("*"))
        steps = F.when(F.col("is_node"), F.concat("steps", F.array(step))).otherwise(F.concat("steps", F.array_repeat(F.lit("*"), F.size("parts") - (level - 1))))
        # Below a node of few URLs nothing is told apart: its paths end here.
        rows = told.withColumns({"steps": steps, "parts": F.when(F.col("is_node"), F.col("parts")).otherwise(F.array().cast("array<string>"))}).select("host", "path", "n", "good", "labelled", "parts", "steps")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def branches_of(leaves: DataFrame, prior: float, weight: float = WEIGHT, apart: float = APART) -> DataFrame:
    """(host, steps, good, labelled) of the branches that stand alone and of hosts' roots; leaves: the same for whole templates."""
    alone: list[DataFrame] = []
    level = durable(leaves.where("labelled > 0").withColumn("depth", F.size("steps")), "leaves")
    depth = level.agg(F.max("depth")).first()[0] or 0
    parent = F.slice("steps", 1, F.size("steps") - 1)
    while depth:
        here = level.where(F.col("depth") == depth).withColumn("parent", parent)
        # The parent's own URLs (paths that end there) are in the pool too.
        pools = here.select("host", "parent", "good", "labelled").unionByName(level.where(F.col("depth") == depth - 1).select("host", F.col("steps").alias("parent"), "good", "labelled"))
        pools = pools.groupBy("host", "parent").agg(F.sum("good").alias("pool_good"), F.sum("labelled").alias("pool_labelled"))
        judged = here.join(_small(durable(pools, "pools")), ["host", "parent"])
        judged = durable(judged.withColumn("alone", differs(F.col("good"), F.col("labelled"), F.col("pool_good"), F.col("pool_labelled"), prior, weight, apart)), "judged")
        alone.append(judged.where("alone").select("host", "steps", "good", "labelled"))
        depth -= 1
        merged = judged.where("not alone").select("host", F.col("parent").alias("steps"), "good", "labelled", F.lit(depth).alias("depth"))
        above = level.where(F.col("depth") <= depth).select("host", "steps", "good", "labelled", "depth").unionByName(merged)
        older, level = level, durable(above.groupBy("host", "steps", "depth").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")), "merged")
        drop(older)
    out = level.select("host", "steps", "good", "labelled")
    for part in alone:
        out = out.unionByName(part)
    return out


def path_text(steps: Column) -> Column:
    return F.when(F.size(steps) == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(steps, "/")))


def judge_templates(urls: DataFrame, weight: float = WEIGHT, apart: float = APART, reject_below: float = REJECT_BELOW) -> DataFrame:
    """host, path, template, branch (the template that it has been merged into), labelled and purity of the branch, method (its verdict)
    of each of distinct_urls."""
    urls = durable(urls, "urls")
    total = urls.agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")).first()
    prior = total.good / total.labelled if total.labelled else 1.0
    templated = durable(add_templates(urls, prior), "templated")
    leaves = durable(templated.groupBy("host", "steps").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")), "leaves")
    branches = durable(branches_of(leaves, prior, weight, apart).select("host", F.col("steps").alias("branch"), F.col("good").alias("b_good"), F.col("labelled").alias("b_labelled")), "branches")
    # A template belongs to the longest branch that it begins with.
    prefix = F.transform(F.sequence(F.lit(0), F.size("steps")), lambda n: F.slice(F.col("steps"), 1, n))
    met = leaves.select("host", "steps", F.explode(prefix).alias("branch")).join(_small(branches), ["host", "branch"])
    longest = met.groupBy("host", "steps").agg(F.max_by(F.struct("branch", "b_good", "b_labelled"), F.size("branch")).alias("b"))
    told = leaves.select("host", "steps").join(longest, ["host", "steps"], "left")
    known, good = F.coalesce("b.b_labelled", F.lit(0)), F.coalesce("b.b_good", F.lit(0))
    purity = (good + weight * prior) / (known + weight)
    judged = told.select("host", "steps", F.coalesce("b.branch", F.array().cast("array<string>")).alias("branch"), known.alias("labelled"), purity.alias("purity"), F.when(purity < reject_below, "block").otherwise("allow").alias("method"))
    out = templated.select("host", "path", "steps").join(_small(durable(judged, "judged")), ["host", "steps"])
    out = durable(out.select("host", "path", path_text(F.col("steps")).alias("template"), path_text(F.col("branch")).alias("branch"), "labelled", "purity", "method"), "templates")
    drop(urls, templated, leaves, branches)
    return out


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, template, branch, purity, verdict.

    labels: url and a 0/1 label, for any URLs; they train the templates, and needn't be pages.
    """
    urls = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    if labels is not None:
        labels = labels.select(host_of(labels["url"]).alias("host"), path_of(labels["url"]).alias("path"), labels["label"].cast("int").alias("label"))
    judged = judge_templates(distinct_urls(urls, labels))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = urls.join(judged, ["host", "path"], "left").withColumns({"rule": rule, "ruled": verdict})
    return out.select("page_id", "host", "path", "rule", "template", "branch", "purity", F.coalesce("ruled", "method", F.lit("allow")).alias("verdict"))
