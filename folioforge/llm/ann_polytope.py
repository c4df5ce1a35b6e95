"""Approximate nearest neighbours by cross-polytope hashing.

A vector is padded to a power of two, turned by three rounds of random signs and a
fast Hadamard transform, and assigned to the signed axis it is nearest to: one of
2 * width buckets, in each of `tables` independent tables. Every vector is indexed. A
query probes, in each table, the share `probes` of the signed axes that are nearest to it; what stands in these
buckets is scored exactly (inner product of the original vectors in double
precision), each pair in the first table that brings it together, and the best k are returned. A query that finds
fewer than k, though there are more candidates, is asked again over all axes, which is exact.

Nearness is the inner product, so long vectors are near to many. Vectors are indexed in bands of length (a factor of 2 each),
all of which a query searches; where lengths differ within a band, those indexed get one more component for hashing, which lifts
all to the band's longest: the nearest axes are those of the largest inner product then, not of the least angle.

Buckets are shuffled in GROUPS groups of axes for each table, so that a vector travels once for each table and a query GROUPS
times, whatever it probes; within a group only the probed buckets are scored. A group with many vectors
or queries is split into tiles of CHUNK by CHUNK_QUERIES, each a task's unit of its own: a hot
vector, bucket or query is spread over tasks and no candidate is dropped. Only the k best of each query leave a
tile. The groups' sizes are broadcast: tables * GROUPS rows for each dimension and band.

At the defaults recall is 0.9 or more of the true 20 nearest on vectors of 64 dimensions that are hardly clustered; these need
about two thirds of all pairs (figures in the README). Where vectors are clustered, fewer probes do.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take
no part, as candidates or queries; so do rows with a null id; vectors are compared with
those of the same dimension; repeated rows of one id count once (the smallest array);
ties go to the smaller vec_id; fewer candidates than k give fewer rows; an empty table gives an empty result; extra columns are
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, drop, durable

TABLES, PROBES = 2, 0.47
GROUPS = 4
CHUNK, CHUNK_QUERIES = 16_384, 4_096
#: Queries scored at once within a tile.
BLOCK = 256
#: Lengths that differ by less than this share count as equal.
EQUAL = 1e-3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def axes(x: np.ndarray, table: int, probes: int, seed: int = 11) -> np.ndarray:
    """For each row the `probes` nearest signed axes after the table's pseudo-rotation, nearest first; axis a with sign - is a + width."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    signs = np.random.default_rng((seed, table, width)).choice((-1.0, 1.0), (3, width))
    y = np.zeros((n, width))
    y[:, :d] = x
    for s in signs:
        y = hadamard(y * s)
    both = np.concatenate((y, -y), axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def width_of(d: int) -> int:
    return max(2, 1 << (d - 1).bit_length())


def _axes_column(vector: Column, longest: Column, tables: int, probes: float | None) -> Column:
    """For each vector an array of tables * probed axes, table after table; probes is a share of the axes, None the nearest axis only.
    longest: the length to lift to, null where none; queries (probes given) get a component of 0."""

    def run(vectors: pa.Array, longest: pa.Array) -> pa.Array:
        out: list = [[] for _ in range(len(vectors))]
        lists = [np.array(v.as_py(), np.float64) for v in vectors]
        for i, most in enumerate(longest.to_pylist()):
            if most is not None:
                lists[i] = np.append(lists[i], 0.0 if probes is not None else np.sqrt(max(0.0, most * most - float(lists[i] @ lists[i]))))
        for d in sorted({len(v) for v in lists}):
            at = [i for i, v in enumerate(lists) if len(v) == d]
            n = 1 if probes is None else min(2 * width_of(d), int(np.ceil(probes * 2 * width_of(d))))
            found = np.concatenate([axes(np.stack([lists[i] for i in at]), t, n) for t in range(tables)], axis=1)
            for i, row in zip(at, found.tolist(), strict=True):
                out[i] = row
        return pa.array(out, pa.list_(pa.int32()))

    run.__annotations__ = {"vectors": pa.Array, "longest": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")(vector, longest)


def _matrix(column: pa.ChunkedArray, rows: int, kind: type) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).astype(kind).reshape(rows, -1)


def probed(point_axes: np.ndarray, query_axes: np.ndarray, table: int) -> np.ndarray:
    """Which queries (rows) meet which points (columns) in this table and in none before it."""
    tables = point_axes.shape[1]
    n = query_axes.shape[1] // tables
    met = np.zeros((len(query_axes), len(point_axes)), bool)
    top = max(int(point_axes.max(initial=0)), int(query_axes.max(initial=0))) + 1
    for t in range(table + 1):
        asked = np.zeros((len(query_axes), top), bool)
        np.put_along_axis(asked, query_axes[:, t * n : (t + 1) * n], True, axis=1)
        here = asked[:, point_axes[:, t]]
        met = here & ~met if t == table else met | here
    return met


def _best_of_tile(k: int):
    def score(queries: pa.Table, points: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if queries.num_rows and points.num_rows:
            table = queries["q_table"][0].as_py()
            q, p = _matrix(queries["q_vector"], queries.num_rows, np.float64), _matrix(points["vector"], points.num_rows, np.float64)
            q_axes, p_axes = _matrix(queries["q_axes"], queries.num_rows, np.int64), _matrix(points["axes"], points.num_rows, np.int64)
            q_ids, p_ids = queries["q_id"].to_numpy(), points["id"].to_numpy()
            order = np.argsort(p_axes[:, table], kind="stable")  # bucket by bucket
            p, p_ids, p_axes = p[order], p_ids[order], p_axes[order]
            cuts = [0, *(np.flatnonzero(np.diff(p_axes[:, table])) + 1).tolist(), len(p)]
            for a in range(0, len(q), BLOCK):
                met = probed(p_axes, q_axes[a : a + BLOCK], table)
                rough = np.full(met.shape, -np.inf)
                for i, j in zip(cuts, cuts[1:]):
                    rows = np.flatnonzero(met[:, i:j].any(1))
                    if len(rows):
                        rough[rows, i:j] = q[a + rows] @ p[i:j].T
                rough[~met | (q_ids[a : a + BLOCK, None] == p_ids[None, :])] = -np.inf
                least = np.partition(rough, max(0, len(p) - k), axis=1)[:, max(0, len(p) - k)]
                slack = 1e-12 * (1 + np.abs(least, where=np.isfinite(least), out=np.zeros_like(least)))
                for i in range(len(rough)):
                    near = np.flatnonzero((rough[i] >= least[i] - slack[i]) & (rough[i] > -np.inf))
                    exact = np.einsum("ij,j->i", p[near], q[a + i])
                    best = np.lexsort((p_ids[near], -exact))[:k]
                    out_q.append(np.full(len(best), q_ids[a + i], np.int64))
                    out_v.append(p_ids[near][best])
                    out_s.append(exact[best])
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, np.int64), (out_v, np.int64), (out_s, np.float64))]
        return pa.table({"query_id": pa.array(joined[0], pa.int64()), "vec_id": pa.array(joined[1], pa.int64()), "score": pa.array(joined[2], pa.float64())})

    return score


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part."""
    v = F.col("vector")
    kind = dict(df.dtypes)[vector_col]  # floats stay floats: half the bytes, and the same numbers
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[vector_col].cast("array<double>" if "double" in kind else "array<float>").alias("vector")).where("id is not null and vector is not null")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine).groupBy("id").agg(F.min("vector").alias("vector"))


def _searched(points: DataFrame, queries: DataFrame, k: int, tables: int, chunk: int, chunk_queries: int) -> DataFrame:
    """(query_id, rank, vec_id, score): points (dim, band, id, vector, axes: one for each table), queries (the same for each band, several axes
    for each table)."""
    axis_of = lambda t, n: F.col("axes")[t * n]
    probes = F.expr(f"int(size(axes) / {tables})")
    table = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table")
    placed = points.select("*", table).withColumn("group", F.pmod(axis_of(F.col("table"), F.lit(1)), F.lit(GROUPS)))
    groups = F.array_distinct(F.transform(F.slice("axes", F.col("table") * F.col("n") + 1, F.col("n")), lambda x: F.pmod(x, F.lit(GROUPS))))
    asked = queries.withColumn("n", probes).select("*", table).withColumn("group", F.explode(groups))
    key = ["dim", "band", "table", "group"]
    sizes = placed.groupBy(key).agg(F.count("*").alias("np")).join(asked.groupBy(key).agg(F.count("*").alias("nq")), key)
    tiles = durable(sizes.select(*key, F.ceil(F.col("np") / chunk).alias("tiles"), F.ceil(F.col("nq") / chunk_queries).alias("query_tiles")), "tiles")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    placed = placed.join(F.broadcast(tiles), key).withColumn("tile", own("tiles")).withColumn("query_tile", every("query_tiles"))
    asked = asked.join(F.broadcast(tiles), key).withColumn("query_tile", own("query_tiles")).withColumn("tile", every("tiles"))
    key += ["tile", "query_tile"]
    theirs = asked.select(*(F.col(c).alias(f"q_{c}") for c in (*key, "id", "vector", "axes")))  # other names: both sides come from one table
    pairs = theirs.groupBy(*(f"q_{c}" for c in key)).cogroup(placed.select(*key, "id", "vector", "axes").groupBy(*key))
    found = pairs.applyInArrow(_best_of_tile(k), "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: float = PROBES, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that is_query (a condition on `id`) holds for, among all other rows."""
    bounded_batches(vectors.sparkSession)
    clean = durable(clean_vectors(vectors, id_col, vector_col).withColumns({"dim": F.size("vector"), "norm": F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))}), "vectors")
    band = F.floor(F.log2("norm") + 0.5).cast("int")
    bands = clean.groupBy("dim", band.alias("band")).agg(F.count("*").alias("rows"), F.max("norm").alias("most"), F.min("norm").alias("least"))
    bands = F.broadcast(durable(bands.select("dim", "band", "rows", F.when(F.col("least") < (1 - EQUAL) * F.col("most"), F.col("most")).alias("longest")), "bands"))
    indexed = lambda rows, n, share: rows.select("dim", "band", "id", "vector", _axes_column(F.col("vector"), F.col("longest"), n, share).alias("axes"))
    points = durable(indexed(clean.withColumn("band", band).join(bands, ["dim", "band"]), tables, None), "points")
    asked = clean.where(is_query)
    found = durable(_searched(points, indexed(asked.join(bands, "dim"), tables, probes), k, tables, chunk, chunk_queries), "found")
    short = asked.join(found.groupBy("query_id").agg(F.count("*").alias("got")), F.col("id") == F.col("query_id"), "left").join(F.broadcast(bands.groupBy("dim").agg(F.sum("rows").alias("all"))), "dim")
    short = durable(short.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("all") - 1)).select("dim", "id", "vector"), "short")
    if not short.limit(1).count():
        return found
    again = _searched(points.withColumn("axes", F.slice("axes", 1, 1)), indexed(short.join(bands, "dim"), 1, 1.0), k, 1, chunk, chunk_queries)
    out = durable(found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again), "nearest")
    drop(clean, points, found, short)
    return out
