"""Quality scores by Bradley-Terry pairwise ranking.

Each text becomes a vector of surface features (shares of capitals, symbols, table
bars, repeated words and so on, over the whole text and over its worst lines). Weights
minimise the logistic loss on the feature differences of preference pairs (a good labelled text
over a poor one), so w.x is the Bradley-Terry strength of a text. A monotone logistic map, fitted on the same
labelled texts, turns strengths into scores from 0 to 1. Documents are kept by a
threshold that is a quantile of the training texts' scores: by default at the share of poor ones
among them, midway between the scores next to it.

Every labelled row counts, for the pairs, the map and the threshold. Rows are dealt into blocks by a hash of their id, HALF of a kind in each
about; the pairs are all those of a block, so a table of HALF rows of either kind is compared in all pairs, and pairs stay linear in the rows. The rarer kind's rows
stand in several blocks, so that each row of the other kind meets HALF of them too. Loss and curvature of a block are products of matrices; no
pair is written down. Up to LOCAL labelled rows are fitted on the driver; more are aggregated by Spark for each of Newton's steps, one row of sums from each
task, with the same result. Scoring covers every row, is independent for each row and needs no shuffle.

Defined cases: a null text is the empty text, which gets a score from its (zero)
features; label rows with null or other values than 0 and 1 are left out;
repeated label rows count once; with labels of one kind only, all scores are 0.5 and the threshold is 0; repeated rows each
give a row, null ids are kept (and never trained on), an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, drop, durable, lean, text_of

#: Labelled rows that are fitted on the driver at most.
LOCAL = 20_000
#: Rows of a kind in a block, about.
HALF = 512
#: Labels that are broadcast at most; beyond it features are joined, not texts.
BROADCAST_LABELS = 2_000_000

_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r", b".,;:?'\"-", b"!", b"|", b"#$%&*+/<=>@\\^_`~", b"()[]{}", bytes(range(128, 256)),
)
_CLASS_OF = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES, 1):
    _CLASS_OF[list(_chars)] = _k
_WIDTH = len(_CLASSES) + 1
#: Characters that stand in tables, shouting and strewn symbols.
_ODD = re.compile(rb"[|!#$%&*+<=>@\\^_`~]")
FEATURES = [f"share_{k}" for k in range(_WIDTH)] + ["log_bytes", "log_lines", "odd_per_word", "worst_odd", "worst_caps", "worst_repeat", "repeat", "distinct", "word_length", "line_repeat"]


def features(text: str) -> list[float]:
    """The feature vector of a text; all zero but for constants where it is empty."""
    data = text.encode()
    n = max(len(data), 1)
    shares = (np.bincount(_CLASS_OF[np.frombuffer(data, np.uint8)], minlength=_WIDTH) / n).tolist()
    lines = data.split(b"\n")
    worst_odd = worst_caps = worst_repeat = repeats = 0.0
    total = letters = 0
    seen: set[bytes] = set()
    odd_all = 0
    for line in lines:
        words = line.split()
        m = len(words)
        if not m:
            continue
        total += m
        letters += sum(map(len, words))
        seen.update(words)
        odd = len(_ODD.findall(line))
        odd_all += odd
        again = sum(map(bytes.__eq__, words, words[1:]))
        repeats += again
        weight = m / (m + 3)  # a line of a few words says less
        worst_odd = max(worst_odd, weight * min(odd / m, 3.0))
        worst_repeat = max(worst_repeat, weight * again / m)
        if line.isupper():
            worst_caps = max(worst_caps, weight)
    m = max(total, 1)
    return [*shares, math.log1p(len(data)), math.log1p(len(lines)), min(odd_all / m, 3.0), worst_odd, worst_caps, worst_repeat, repeats / m, len(seen) / m, letters / m / 10, 1 - len(set(lines)) / len(lines)]


@dataclass(frozen=True)
class Ranker:
    """Weights over standardised features, the logistic map a * strength + b, and the quantile threshold."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    a: float
    b: float
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * self.strengths(x) + self.b)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale * self.weights).sum(1)  # a row's sum doesn't depend on the rows beside it


Sums = tuple[np.ndarray, np.ndarray, float]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _newton(sums: Callable[[np.ndarray], Sums], width: int, l2: float, steps: int = 30) -> np.ndarray:
    """Weights that minimise a mean loss + l2 |w|^2 by Newton's steps; sums gives gradient, curvature and number of the terms at w."""
    w = np.zeros(width)
    for _ in range(steps):
        gradient, curve, n = sums(w)
        step = np.linalg.solve(curve / n + (l2 + 1e-9) * np.eye(width), gradient / n + l2 * w)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _pair_sums(good: np.ndarray, poor: np.ndarray, w: np.ndarray) -> Sums:
    """Of the logistic loss of all pairs of good and poor standardised rows."""
    p = _sigmoid(np.subtract.outer(good @ w, poor @ w))
    q = p * (1 - p)
    cross = good.T @ q @ poor
    return good.T @ (p - 1).sum(1) - poor.T @ (p - 1).sum(0), good.T @ (good * q.sum(1)[:, None]) + poor.T @ (poor * q.sum(0)[:, None]) - cross - cross.T, float(p.size)


def _map_sums(strength: np.ndarray, y: np.ndarray, w: np.ndarray) -> Sums:
    """Of the logistic loss of labels by w[0] + w[1] * strength."""
    x = np.column_stack((np.ones(len(y)), strength))
    p = _sigmoid(x @ w)
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x, float(len(y))


def _total(parts: list[Sums]) -> Sums:
    return sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts)


def _blocks(good: int, poor: int) -> tuple[int, int]:
    """Numbers of blocks that good and poor rows are dealt into. Block b of the kind that has more meets block b % (the fewer) of the other."""
    return max(1, good // HALF), max(1, poor // HALF)


def _threshold_place(good: int, poor: int, quantile: float | None) -> float:
    return (poor / (good + poor) if quantile is None else quantile) * (good + poor - 1)


def _no_model(width: int) -> Ranker:
    return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 1.0, 0.0, 0.0)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, quantile: float | None = None, keys: np.ndarray | None = None) -> Ranker:
    """A model from feature rows and their 0/1 labels; keys deal rows into blocks (by default their numbers)."""
    width = x.shape[1]
    keys = np.arange(len(y)) if keys is None else keys
    if not (y == 1).any() or not (y == 0).any():
        return _no_model(width)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    good, poor = z[y == 1], z[y == 0]
    g, p = _blocks(len(good), len(poor))
    of_good, of_poor = keys[y == 1] % g, keys[y == 0] % p
    blocks = [(good[of_good == b % g], poor[of_poor == b % p]) for b in range(max(g, p))]
    w = _newton(lambda w: _total([_pair_sums(a, b, w) for a, b in blocks]), width, l2)
    strength = Ranker(centre, scale, w, 1.0, 0.0, 0.0).strengths(x)
    b, a = _newton(lambda w: _map_sums(strength, y, w), 2, 1e-6)
    model = Ranker(centre, scale, w, float(a), float(b), 0.0)
    scores, place = np.sort(model.scores(x)), _threshold_place(len(good), len(poor), quantile)
    return replace(model, threshold=float((scores[math.floor(place)] + scores[math.ceil(place)]) / 2))


def _summed(table: DataFrame, of_batch: Callable[..., np.ndarray], width: int) -> np.ndarray:
    """The sum of of_batch (a vector) over the Arrow batches of a table; each task gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        out = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                out += of_batch(batch)
        yield pa.record_batch([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

    rows = table.mapInArrow(run, "s array<double>").collect()
    return np.sum([r.s for r in rows] or [np.zeros(width)], axis=0)


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _flat(sums: Sums) -> np.ndarray:
    return np.concatenate((sums[0], sums[1].ravel(), [sums[2]]))


def _unflat(flat: np.ndarray, width: int) -> Sums:
    return flat[:width], flat[width:-1].reshape(width, width), float(flat[-1])


def _nth(scores: DataFrame, place: float) -> float:
    """Midway between the scores at the two whole places next to `place` in order; counted in ever narrower bins."""
    low, high, before, bins, at = 0.0, 1.0, 0, 1023, math.floor(place)
    while low < high:
        bin_ = F.floor((F.col("score") - low) / (high - low) * bins)
        told = scores.where(F.col("score").between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("bin").collect()  # bins + 1 rows at most
        for r in told:
            if at < before + r.n:
                low, high = r.low, r.high
                break
            before += r.n
    if math.ceil(place) == at:
        return low
    up = scores.agg(F.count_if(F.col("score") <= low).alias("n"), F.min(F.when(F.col("score") > low, F.col("score"))).alias("next")).first()
    return low if up.n > at + 1 else (low + up.next) / 2


def _fit_table(rows: DataFrame, good: int, poor: int, l2: float = 1e-3, quantile: float | None = None) -> Ranker:
    """fit over a table (key, mark, x) with rows of both kinds, by sums over its tasks."""
    width, n = len(FEATURES), good + poor
    xs = rows.select("x")
    centre = _summed(xs, lambda b: _matrix(b.column(0), width).sum(0), width) / n
    scale = np.sqrt(_summed(xs, lambda b: ((_matrix(b.column(0), width) - centre) ** 2).sum(0), width) / n) + 1e-6
    kinds, most = _blocks(good, poor), max(_blocks(good, poor))
    dealt = F.when(F.col("mark") == 1, F.pmod("key", F.lit(kinds[0]))).otherwise(F.pmod("key", F.lit(kinds[1])))
    own = F.when(F.col("mark") == 1, kinds[0]).otherwise(kinds[1])
    placed = rows.select("mark", "x", F.explode(F.sequence(dealt, F.lit(most - 1).cast("bigint"), own.cast("bigint"))).alias("block"))
    lists = [F.collect_list(F.when(F.col("mark") == m, F.col("x"))).alias(c) for m, c in ((1, "good"), (0, "poor"))]
    blocks = durable(placed.groupBy("block").agg(*lists).select("good", "poor"), "blocks")

    def pairs(w: np.ndarray) -> Sums:
        def of_batch(batch: pa.RecordBatch) -> np.ndarray:
            both = zip(*([(_matrix(v.values, width) - centre) / scale for v in batch.column(c)] for c in (0, 1)), strict=True)
            return np.sum([_flat(_pair_sums(g, p, w)) for g, p in both], axis=0)

        return _unflat(_summed(blocks, of_batch, width + width**2 + 1), width)

    w = _newton(pairs, width, l2)
    drop(blocks)
    model = Ranker(centre, scale, w, 1.0, 0.0, 0.0)
    marked = rows.select("x", "mark")

    def labels(w: np.ndarray) -> Sums:
        return _unflat(_summed(marked, lambda b: _flat(_map_sums(model.strengths(_matrix(b.column(0), width)), b.column(1).to_numpy(), w)), 7), 2)

    b, a = _newton(labels, 2, 1e-6)
    model = replace(model, a=float(a), b=float(b))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array(model.scores(_matrix(batch.column(0), width)))], ["score"])

    scores = durable(xs.mapInArrow(score, "score double"), "scores")
    threshold = _nth(scores, _threshold_place(good, poor, quantile))
    drop(scores)
    return replace(model, threshold=float(threshold))


def _feature_arrays(texts: pa.Array) -> pa.Array:
    lean()
    return pa.array([features(t.as_py() or "") for t in texts], pa.list_(pa.float64()))


def feature_column(text: Column) -> Column:
    return F.arrow_udf(_feature_arrays, "array<double>")(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", quantile: float | None = None) -> Ranker:
    """A model from all labelled rows of docs; labels: id and a 0/1 label. At most LOCAL rows reach the driver."""
    bounded_batches(docs.sparkSession)
    marks = labels.select(labels[id_col].alias("mark_id"), labels[label_col].alias("mark")).where("mark in (0, 1) and mark_id is not null").groupBy("mark_id").agg(F.max("mark").cast("int").alias("mark"))
    texts = docs.select(docs[id_col].alias("mark_id"), text_of(docs, text_col).alias("text"))
    told = ["mark_id", feature_column(F.col("text")).alias("x")]
    if marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        found = texts.join(F.broadcast(marks), "mark_id").select("mark", *told)
    else:
        found = texts.select(*told).join(marks, "mark_id")
    rows = durable(found.select(F.xxhash64("mark_id").alias("key"), "mark", "x"), "labelled")
    n = rows.agg(F.count_if(F.col("mark") == 1).alias("good"), F.count_if(F.col("mark") == 0).alias("poor")).first()
    if not n.good or not n.poor:
        model = _no_model(len(FEATURES))
    elif n.good + n.poor > LOCAL:
        model = _fit_table(rows, n.good, n.poor, quantile=quantile)
    else:
        own = sorted(rows.select("mark", "x", "key").collect())
        model = fit(np.array([r.x for r in own]), np.array([r.mark for r in own]), quantile=quantile, keys=np.array([r.key for r in own]))
    drop(rows)
    return model


def score_column(text: Column, model: Ranker) -> Column:
    """Column of scores from 0 to 1 of a text column."""

    def run(texts: pa.Array) -> pa.Array:
        lean()
        if not len(texts):
            return pa.array([], pa.float64())
        return pa.array(model.scores(np.array([features(t.as_py() or "") for t in texts])))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(text)


def quality_scores(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score, keep (the score reaches the model's quantile threshold)."""
    bounded_batches(docs.sparkSession)
    scored = docs.select(docs[id_col].alias("doc_id"), score_column(text_of(docs, text_col), model).alias("score"))
    return scored.withColumn("keep", F.col("score") >= model.threshold)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text divides by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
