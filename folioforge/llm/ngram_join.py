"""N-gram Jaccard join with signature trees.

A document's set holds its distinct k-word shingles, as 64-bit hashes; sets are told apart by a 64-bit hash too. Two
documents link when 100 * intersection >= THRESHOLD * union. But for collisions of these hashes (about n ** 2 / 2 ** 65 sets of n)
the result is exact: every filter below only drops pairs that cannot link.

1. Blocks. Tokens are ordered by (frequent, hash), where `frequent` is a fixed set counted
   over all documents, one in FREQUENT_SHARE or more of them. Linked sets share a
   token among the first n - ceil(0.8 n) + 1 of each, so each set enters the blocks of
   these tokens only; passages common to many documents fall out of them.
2. Pivots. In each block a set is compared with PIVOTS pivots at most (those least in as
   many fixed orders), which joins copies in linear time, however large their group.
   The links' components are contracted: a block within one component is done.
3. Signature trees. Sets of the other blocks (blocks of equal members count once) are cut
   into tiles of TILE, each pair of tiles a task's unit. A tile's sets become the leaves
   of a tree whose nodes hold the OR of their token bitmaps, the range of their sizes
   and components. Two trees are traversed together; a pair of nodes is pruned when
   sizes are too far apart, when all is one component, or when the largest possible
   overlap (common bits and the hash excess, or the sizes) is too small. The pairs of sets that are left are
   verified once each; a unit with more than PAIRS of them for each set is traversed again with
   its shingles and keeps a spanning forest of exact links.
4. Components of all links.
5. On request, the number of each set's links: the sets of a component are compared in tiles, by the sizes of all intersections of two
   tiles at once. Only the numbers leave a task. This is the one step whose work grows with the square of the different texts
   in a component (not of their copies); it is spread over tasks, COUNT_SETS sets against COUNT_SETS.

What is shuffled: prefix tokens with ids (a fifth of the shingles), bitmaps and
shingles of sets with a possible partner, once each for a block or pivot, and for each pair of tiles. Pivot pairs, flags and
forests are linear in the sets; a block of m sets enters ceil(m / TILE) units each.

Defined cases: a null or blank text has no shingles and links with nothing; fewer words
than k are one shingle; rows with equal sets are one set, so copies cost nothing; a null
doc_id stays null and takes part as text; component_id is the least doc_id of the
component, null only if all its ids are null; repeated rows each give a row; an empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .components import components
from .shared import bounded_batches, drop, durable, lean, text_of, trim
from .shared_keys import shared_keys

WORDS, THRESHOLD = 5, 80
#: Bits of the bitmap of a set of up to PER_BASE tokens; twice as many for each doubling of the size.
BITS, PER_BASE = 1024, 512
#: Longer sets are compared by 4-byte hashes, and by 8-byte hashes where that leaves MARGIN tokens of doubt.
LONG, MARGIN = 2048, 4
FREQUENT_SHARE, FREQUENT_LEAST = 4096, 64
PIVOTS = 2
TILE = 1024
FAN = 8
#: Pairs that a unit hands on for each of its sets; a unit with more of them keeps a spanning forest instead.
PAIRS = 4
#: UTF-8 bytes of the texts that are hashed together.
SLICE = 500_000
#: Shingles that are counted together in a worker before the counts go on.
COUNTED = 2_000_000
#: Bytes of the units that are traversed together.
TOGETHER = 8 << 20
#: Sets, and tokens, of a tile whose links are counted.
COUNT_SETS, COUNT_TOKENS = 2048, 2_000_000
#: Rows of ids that are broadcast at most.
BROADCAST_IDS = 2_000_000


# What runs in Python workers


def _frequent_here(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(token, n): tokens of three or more different sets among texts of about COUNTED shingles together."""

    def often(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(list(sets.values()) or [np.zeros(0, np.uint64)])
        sets.clear()
        every.sort()
        begin = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        n = np.diff(np.append(begin, len(every)))
        return pa.record_batch([pa.array(every[begin[n >= 3]].view(np.int64)), pa.array(n[n >= 3].astype(np.int64))], ["token", "n"])

    held: dict[int, np.ndarray] = {}
    size = 0
    for batch in batches:
        for _, texts in wordhash.slices(batch.column(0), SLICE):
            for s in wordhash.shingle_sets(texts, k):
                if len(s) and (key := set_id(s)) not in held:
                    held[key] = s
                    size += len(s)
            if size >= COUNTED:
                yield often(held)
                held, size = {}, 0
    yield often(held)
    trim()


def size_class(n: int) -> int:
    """0 up to PER_BASE tokens, one more for each doubling."""
    return max(0, (n - 1).bit_length() - PER_BASE.bit_length() + 1) if n > PER_BASE else 0


def bitmap(tokens: np.ndarray, cls: int | None = None) -> np.ndarray:
    """BITS << class bits as uint64 words, one set for the top bits of each token."""
    width = BITS << (size_class(len(tokens)) if cls is None else cls)
    bits = np.zeros(width, bool)
    bits[(tokens >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a smaller width: neighbouring bits are joined."""
    while len(bits) > words:
        bits = np.packbits(np.unpackbits(bits.view(np.uint8)).reshape(-1, 2).any(1)).view(np.uint64)
    return bits


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    h = wordhash.mix(np.array([wordhash.mix(tokens ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))
    return int(h.view(np.int64)[0])


def prefix(tokens: np.ndarray, frequent: np.ndarray, threshold: int) -> np.ndarray:
    """The first tokens in the order (frequent, hash) among which a linked set has one too; tokens are sorted."""
    n = len(tokens)
    p = n - (threshold * n + 99) // 100 + 1 if n else 0
    if p and len(frequent):
        first = tokens[:p]
        if (frequent[np.minimum(np.searchsorted(frequent, first), len(frequent) - 1)] == first).any():
            hot = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
            return np.concatenate((tokens[~hot], tokens[hot]))[:p]
    return tokens[:p]


def _signatures(batches: Iterator[pa.RecordBatch], k: int, threshold: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, rid, n, bits, tokens) of each row (doc_id, text)."""
    for batch in batches:
        for at, texts in wordhash.slices(batch.column(1), SLICE):
            sets = wordhash.shingle_sets(texts, k)
            heads = [prefix(s, frequent, threshold) for s in sets]
            ends = np.cumsum([0, *map(len, heads)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(heads).view(np.int64)))
            yield pa.record_batch(
                [batch.column(0).slice(at, len(texts)), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()), tokens],
                ["doc_id", "rid", "n", "bits", "tokens"],
            )


def _prefix_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(token, rid, n) of rows (rid, n, tokens)."""
    tokens = batch.column(2)
    many = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    return tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64), *(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), many) for c in (0, 1))


def _sets(batches: Iterator[pa.RecordBatch], k: int, short: bool) -> Iterator[pa.RecordBatch]:
    """(rid, n, shingles) of each text that has any; with short, 4 bytes each where there are more than LONG."""
    for batch in batches:
        for _, texts in wordhash.slices(batch.column(0), SLICE):
            sets = [s for s in wordhash.shingle_sets(texts, k) if len(s)]
            held = [_short(s).tobytes() if short and len(s) > LONG else s.tobytes() for s in sets]
            yield pa.record_batch([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(held, pa.binary())], ["rid", "n", "shingles"])


def _short(tokens: np.ndarray) -> np.ndarray:
    """The distinct top halves of sorted tokens."""
    x = (tokens >> np.uint64(32)).astype(np.uint32)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def links(overlap, a, b, threshold: int):
    return 100 * overlap >= threshold * (a + b - overlap)


def possible_overlap(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most tokens that sets with these bitmaps can share: each bit that one has and the other lacks is a token of its own."""
    return np.minimum(n_a - np.bitwise_count(bits_a & ~bits_b).sum(1, dtype=np.int64), n_b - np.bitwise_count(bits_b & ~bits_a).sum(1, dtype=np.int64))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _may_link(threshold: int):
    def run(bits_a: pa.Array, bits_b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        lean()
        out = []
        for x, y, m, n in zip(bits_a, bits_b, n_a.to_pylist(), n_b.to_pylist(), strict=True):
            u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            words = min(len(u), len(v))
            u, v = folded(u, words)[None], folded(v, words)[None]
            out.append(bool(links(possible_overlap(u, v, np.array([m]), np.array([n]))[0], m, n, threshold)))
        return pa.array(out, pa.bool_())

    run.__annotations__ = dict.fromkeys(("bits_a", "bits_b", "n_a", "n_b", "return"), pa.Array)
    return F.arrow_udf(run, "boolean")


def _do_link(threshold: int):
    """1 where two sets link, 0 where they don't, null where 4-byte hashes leave it open."""

    def run(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        lean()
        out = []
        for x, y, m, n in zip(a, b, n_a.to_pylist(), n_b.to_pylist(), strict=True):
            u, v = (np.frombuffer(z.as_buffer(), np.uint64 if len(z.as_buffer()) == 8 * size else np.uint32) for z, size in ((x, m), (y, n)))
            if u.dtype == v.dtype == np.uint64:
                out.append(int(links(common(u, v), m, n, threshold)))
                continue
            o = common(*(z if z.dtype == np.uint32 else _short(z) for z in (u, v)))
            sure, never = links(o - MARGIN, m, n, threshold), not links(o + MARGIN, m, n, threshold)
            out.append(1 if sure else 0 if never else None)
        return pa.array(out, pa.int32())

    run.__annotations__ = dict.fromkeys(("a", "b", "n_a", "n_b", "return"), pa.Array)
    return F.arrow_udf(run, "int")


class Trees:
    """Signature trees over leaves in order of (root, size): one for each root number."""

    def __init__(self, root: np.ndarray, n: np.ndarray, c: np.ndarray, bits: np.ndarray):
        excess = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        level = {"root": root, "lo": n, "hi": n, "c0": c, "c1": c, "excess": excess, "bits": bits}
        self.levels = [level]
        self.first_child: list[np.ndarray] = []  # of each node of the level above; the last entry is the level's length
        while len(np.unique(level["root"])) < len(level["root"]):
            r = level["root"]
            begin = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            within = np.arange(len(r)) - np.repeat(begin, np.diff([*begin, len(r)]))
            cut = np.flatnonzero(within % FAN == 0)
            level = {
                "root": r[cut], "lo": np.minimum.reduceat(level["lo"], cut), "hi": np.maximum.reduceat(level["hi"], cut), "c0": np.minimum.reduceat(level["c0"], cut), "c1": np.maximum.reduceat(level["c1"], cut),
                "excess": np.maximum.reduceat(level["excess"], cut), "bits": np.bitwise_or.reduceat(level["bits"], cut, axis=0),
            }
            self.levels.append(level)
            self.first_child.append(np.append(cut, len(r)))

    def alive(self, depth: int, x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
        """Which pairs of nodes of a level may hold a link between different components."""
        v = self.levels[depth]
        size = (100 * v["hi"][x] >= threshold * v["lo"][y]) & (100 * v["hi"][y] >= threshold * v["lo"][x])
        one = (v["c0"][x] == v["c1"][x]) & (v["c0"][x] == v["c0"][y]) & (v["c0"][y] == v["c1"][y])
        keep = np.flatnonzero(size & ~one)
        x, y = x[keep], y[keep]
        if depth:
            common = np.bitwise_count(v["bits"][x] & v["bits"][y]).sum(1, dtype=np.int64) + np.minimum(v["excess"][x], v["excess"][y])
            most = np.minimum(np.minimum(v["hi"][x], v["hi"][y]), common)
        else:
            most = possible_overlap(v["bits"][x], v["bits"][y], v["lo"][x], v["lo"][y])
        out = np.zeros(len(size), bool)
        out[keep] = (100 + threshold) * most >= threshold * (v["lo"][x] + v["lo"][y])
        return out

    def pairs(self, roots: list[tuple[int, int]], threshold: int, step: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that no bound excludes, of each pair of roots (a root with itself: each pair once)."""
        at = {int(r): i for i, r in enumerate(self.levels[-1]["root"])}
        top = np.array([(at[a], at[b]) for a, b in roots if a in at and b in at], np.int64).reshape(-1, 2)
        stack = [(len(self.levels) - 1, top[i : i + step]) for i in range(0, len(top), step)]
        while stack:
            depth, pair = stack.pop()
            pair = pair[self.alive(depth, pair[:, 0], pair[:, 1], threshold)]
            if not len(pair):
                continue
            if not depth:
                pair = pair[pair[:, 0] != pair[:, 1]]
                yield pair[:, 0], pair[:, 1]
                continue
            first = self.first_child[depth - 1]
            nx, ny = first[pair[:, 0] + 1] - first[pair[:, 0]], first[pair[:, 1] + 1] - first[pair[:, 1]]
            many = nx * ny
            which = np.repeat(np.arange(len(pair)), many)
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            x, y = first[pair[which, 0]] + k // ny[which], first[pair[which, 1]] + k % ny[which]
            below = np.column_stack((x, y))[(pair[which, 0] != pair[which, 1]) | (x <= y)]
            stack += [(depth - 1, below[i : i + step]) for i in range(0, len(below), step)]


def _traverse(batches: Iterator[pa.RecordBatch], threshold: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows (unit, cls, side, rid, n, c, bits or shingles) in order of unit: candidates (unit, a, b), or sets (unit, a) of units
    with many of them; with exact, links (a, b). Units of about TOGETHER bytes are traversed at once."""
    lean()
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= TOGETHER and held[0].column(0)[0].as_py() != batch.column(0)[-1].as_py():
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            unit = whole["unit"].to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            yield from _by_class(whole.slice(0, cut), threshold, exact)
            held = whole.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if size:
        yield from _by_class(pa.Table.from_batches(held).combine_chunks(), threshold, exact)
    trim()


def _by_class(rows: pa.Table, threshold: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Units of one class together: their bitmaps have one width."""
    cls = rows["cls"].to_numpy()
    for c in np.unique(cls).tolist():
        yield from _traverse_units(rows.filter(pa.array(cls == c)).combine_chunks(), c, threshold, exact)


def _traverse_units(rows: pa.Table, cls: int, threshold: int, exact: bool) -> Iterator[pa.RecordBatch]:
    unit, side, n = rows["unit"].to_numpy(), rows["side"].to_numpy().astype(np.int64), rows["n"].to_numpy()
    number = np.unique(unit, return_inverse=True)[1]
    root = number * 2 + side
    order = np.lexsort((rows["rid"].to_numpy(), n, root))
    root, n, unit = root[order], n[order], unit[order]
    rid, c = rows["rid"].to_numpy()[order], rows["c"].to_numpy()[order]
    if exact:
        sets = [np.frombuffer(rows["shingles"][int(i)].as_py(), np.uint64) for i in order]
        bits = np.stack([bitmap(s, cls) for s in sets])
    else:
        words = (BITS << cls) // 64
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["bits"].chunk(0)]
        bits = np.stack([folded(held[int(i)], words) for i in order])
    trees = Trees(root, n, c, bits)
    there = set(root.tolist())
    roots = [(2 * u, 2 * u + 1) if 2 * u + 1 in there else (2 * u, 2 * u) for u in np.unique(number).tolist() if 2 * u in there]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    flagged, many = np.zeros(len(rid), bool), np.zeros(len(rid), np.int64)
    place, size = np.unique(unit, return_inverse=True)[1], np.unique(unit, return_counts=True)[1]  # many: by a unit's place, pairs so far
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    a, b = [], []
    for x, y in trees.pairs(roots, threshold):
        if not exact:
            flagged[x] = flagged[y] = True
            many[: len(size)] += np.bincount(place[x], minlength=len(size))
            few = many[place[x]] <= PAIRS * size[place[x]]
            found.append((x[few], y[few]))
            continue
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            u = int(unit[i])
            p, q = find((u, int(c[i]))), find((u, int(c[j])))
            if p != q and links(common(sets[i], sets[j]), len(sets[i]), len(sets[j]), threshold):
                parent[p] = q
                a.append(int(rid[i]))
                b.append(int(rid[j]))
    if exact:
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    else:
        dense = many[place] > PAIRS * size[place]
        x, y = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for i in (0, 1))
        sparse = ~dense[x]
        x, y, z = x[sparse], y[sparse], np.flatnonzero(flagged & dense)
        yield pa.record_batch([pa.array(np.concatenate((unit[x], unit[z])), pa.int64()), pa.array(np.concatenate((rid[x], rid[z])), pa.int64()), pa.concat_arrays([pa.array(rid[y], pa.int64()), pa.nulls(len(z), pa.int64())])], ["unit", "a", "b"])


def _linked(a: list[np.ndarray], b: list[np.ndarray], threshold: int) -> np.ndarray:
    """Which sets of a (rows) link with which of b (columns)."""
    n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
    every = np.concatenate(a + b)
    own = np.repeat(np.arange(len(a) + len(b)), np.concatenate((n_a, n_b)))
    _, token, many = np.unique(every, return_inverse=True, return_counts=True)
    common_ = many[token] > 1  # others are in no intersection
    place = np.cumsum(many > 1) - 1
    row, column = own[common_], place[token[common_]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(a), len(b)), np.float32)
    width = max(256, 4_000_000 // (len(a) + len(b)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (low, low + width))
        held = np.zeros((len(a) + len(b), width), np.float32)
        held[row[i:j], column[i:j] - low] = 1
        overlap += held[: len(a)] @ held[len(a) :].T
    return links(overlap.astype(np.int64), n_a[:, None], n_b[None, :], threshold)


def _degrees(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """(rid, n_texts, n_docs): rows (unit, side, rid, copies, shingles) in order of unit, two tiles of a class each (or one, with itself): how
    many of the other tile's sets a set links with, and of how many documents these are."""
    lean()
    current, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        side = np.array([h[0] for h in held])
        rid, copies = (np.array([h[n] for h in held], np.int64) for n in (1, 2))
        sets = [np.frombuffer(h[3], np.uint64) for h in held]
        held.clear()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right)
        right = left if alone else right
        linked = _linked([sets[i] for i in left], [sets[i] for i in right], threshold)
        if alone:
            np.fill_diagonal(linked, False)
        parts = [(rid[left], linked, copies[right])] + ([] if alone else [(rid[right], linked.T, copies[left])])
        for ids, found, weight in parts:
            yield pa.record_batch([pa.array(ids), pa.array(found.sum(1).astype(np.int64)), pa.array(found @ weight)], ["rid", "n_texts", "n_docs"])

    for batch in batches:
        units = batch.column(0).to_pylist()
        for i, row in enumerate(zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)), batch.column(4), strict=True)):
            if units[i] != current:
                yield from done()
                current = units[i]
            held.append((*row[:3], row[3].as_py()))
    yield from done()
    trim()


# The plan


def _frequent(texts: DataFrame, k: int) -> np.ndarray:
    """Tokens of one in FREQUENT_SHARE documents or more, sorted: at most FREQUENT_SHARE times the mean set size of them."""
    least = max(FREQUENT_LEAST, texts.count() // FREQUENT_SHARE)
    counted = texts.select("text").mapInArrow(lambda b: _frequent_here(b, k), "token bigint, n bigint")
    rows = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("token").toArrow()
    return np.sort(rows["token"].to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def _with_sets(wanted: DataFrame, signed: DataFrame, texts: DataFrame, k: int, short: bool) -> DataFrame:
    """(rid, n, shingles) of the rids in wanted (distinct), from one document of each; a few others may come along."""
    sources = durable(signed.join(wanted, "rid", "left_semi").groupBy("rid").agg(F.min("doc_id").alias("doc_id")), "sources")
    ids = sources.where("doc_id is not null").select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    made = lambda df: df.select("text").mapInArrow(lambda b: _sets(b, k, short), "rid bigint, n bigint, shingles binary")
    named = made(texts.where("doc_id is not null").join(ids, "doc_id", "left_semi"))
    out = durable(named.unionByName(made(texts.where("doc_id is null")).dropDuplicates(["rid"])), "sets")
    drop(sources)
    return out


def _verified(pairs: DataFrame, signed: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of sets that link."""

    def judged(pairs: DataFrame, short: bool) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
        sets = _with_sets(wanted, signed, texts, k, short)
        side = lambda c, x, n: sets.select(F.col("rid").alias(c), F.col("shingles").alias(x), F.col("n").alias(n))
        both = pairs.join(side("a", "x", "n_x"), "a").join(side("b", "y", "n_y"), "b")
        out = durable(both.select("a", "b", _do_link(threshold)(F.col("x"), F.col("y"), F.col("n_x"), F.col("n_y")).alias("link")), "judged")
        drop(sets)
        return out

    first = judged(pairs, True)
    found, open_ = first.where("link = 1").select("a", "b"), first.where("link is null").select("a", "b").distinct()
    if open_.limit(1).count():
        found = found.unionByName(judged(open_, False).where("link = 1").select("a", "b"))
    out = durable(found.distinct(), "verified")
    drop(first)
    return out


def _link_counts(named: DataFrame, signed: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """(rid, n_texts, n_docs) of the sets in named (rid, class, n_shingles) that share their class with another: every link of theirs."""
    sets = durable(named.where("rid is not null").groupBy("class", "rid").agg(F.count("*").alias("copies"), F.first("n_shingles").alias("n")), "distinct")
    size = sets.groupBy("class").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).where("m > 1")
    tiles = F.ceil(F.greatest(F.col("m") / COUNT_SETS, F.col("tokens") / COUNT_TOKENS)).cast("int")
    placed = sets.join(size.select("class", tiles.alias("tiles")), "class").select("class", "rid", "copies", "tiles", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int").alias("tile"))
    placed = durable(placed, "placed")
    shingles = _with_sets(placed.select("rid"), signed, texts, k, False).select("rid", "shingles").dropDuplicates(["rid"])
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = placed.select("class", "rid", "copies", "tile", other).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other"), "side": F.when(F.col("tile") <= F.col("other"), 0).otherwise(1)})
    units = pairs.select(F.xxhash64("class", "i", "j").alias("unit"), "side", "rid", "copies").join(shingles, "rid").select("unit", "side", "rid", "copies", "shingles")
    counted = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda b: _degrees(b, threshold), "rid bigint, n_texts bigint, n_docs bigint")
    out = durable(counted.groupBy("rid").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs")), "degrees")
    drop(sets, placed)
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, threshold: int = THRESHOLD, tile: int = TILE, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has doc_id, n_shingles, rid (its set's id) and component_id for each row of docs;
    links has pairs of set ids (a, b) that span the components, each a true link. With count, members also has n_links (the other
    rows that a row links with, copies included) and n_texts (the other sets): all links are counted then, not only the spanning ones."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(texts, k))
    whole = durable(texts.mapInArrow(lambda b: _signatures(b, k, threshold, frequent.value), "doc_id bigint, rid bigint, n bigint, bits binary, tokens array<bigint>"), "prefixes")
    signed = whole.drop("tokens")

    held = shared_keys(whole.where("rid is not null").select("rid", "n", "tokens"), _prefix_rows, ["token", "rid", "n"], whole.agg(F.sum(F.size("tokens"))).first()[0] or 0)
    members = durable(held.groupBy("token", "rid").agg(F.first("n").alias("n")), "members")

    # Pivots
    by_order = F.xxhash64("rid", F.pmod("token", F.lit(PIVOTS)))
    pivots = members.groupBy("token").agg(F.min_by(F.struct("rid", "n"), by_order).alias("pivot"))
    pairs = members.join(pivots, "token").where("rid <> pivot.rid").groupBy(F.col("rid").alias("a"), F.col("pivot.rid").alias("b")).agg(F.first("n").alias("n_a"), F.first("pivot.n").alias("n_b"))
    near = pairs.where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    bits = signed.where("rid is not null").groupBy("rid").agg(F.first("bits").alias("bits"))
    bits = durable(bits.join(members.select("rid").distinct(), "rid", "left_semi"), "bits")
    both = near.join(bits.select(F.col("rid").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("rid").alias("b"), F.col("bits").alias("bits_b")), "b")
    likely = durable(both.where(_may_link(threshold)(F.col("bits_a"), F.col("bits_b"), F.col("n_a"), F.col("n_b"))).select("a", "b"), "likely")
    first = _verified(likely, signed, texts, k, threshold)
    drop(likely)
    contracted = components(first)

    # Signature trees, over blocks that hold several components
    labelled = members.select("token", "rid", "n").join(contracted.withColumnRenamed("node", "rid"), "rid", "left").select("token", "rid", "n", F.coalesce("component", "rid").alias("c"))
    labelled = durable(labelled, "labelled")
    drop(members, contracted)
    blocks = labelled.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor("rid").alias("x"), F.bit_xor(F.xxhash64("rid")).alias("y"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    blocks = blocks.where("c0 <> c1").groupBy("m", "x", "y").agg(F.min("token").alias("token"))
    tiles = F.ceil(F.col("m") / tile).cast("int")
    own = labelled.join(blocks.select("token", tiles.alias("tiles")), "token").withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    # Sets that can link are in the same or neighbouring steps of size; each meets its own step and the next in one unit.
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(101 / threshold)).cast("int")
    units = own.withColumn("other", other).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other"), "side": F.when(F.col("tile") <= F.col("other"), 0).otherwise(1)})
    units = units.withColumn("step", F.explode(F.array(step, step - 1))).select(F.xxhash64("token", "i", "j", "step").alias("unit"), "side", "rid", "n", "c")
    size = F.greatest(F.lit(0), F.length(F.bin(F.min("n") - 1)) - (PER_BASE.bit_length() - 1))
    mixed = units.groupBy("unit").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), size.alias("cls")).where("c0 <> c1").select("unit", "cls")
    units = durable(units.join(mixed, "unit"), "units")
    drop(labelled)
    placed = lambda df: df.repartition("unit").sortWithinPartitions("unit")
    candidates = placed(units.join(bits, "rid").select("unit", "cls", "side", "rid", "n", "c", "bits")).mapInArrow(lambda b: _traverse(b, threshold, False), "unit bigint, a bigint, b bigint")
    candidates = durable(candidates, "candidates")
    drop(bits)
    pairs = candidates.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = durable(pairs, "pairs")
    second = _verified(pairs, signed, texts, k, threshold)
    drop(pairs)
    flagged = candidates.where("b is null").select("unit", F.col("a").alias("rid")).distinct()
    if flagged.limit(1).count():
        more = _with_sets(flagged.select("rid").distinct(), signed, texts, k, False)
        whole = units.join(flagged, ["unit", "rid"], "left_semi").join(more.select("rid", "shingles").dropDuplicates(["rid"]), "rid").select("unit", "cls", "side", "rid", "n", "c", "shingles")
        second = second.unionByName(durable(placed(whole).mapInArrow(lambda b: _traverse(b, threshold, True), "a bigint, b bigint"), "forest"))
        drop(more)
    drop(units, candidates)

    spanning = first.unionByName(second)
    final = components(spanning)
    named = signed.select("doc_id", "rid", "n").join(final.withColumnRenamed("node", "rid"), "rid", "left").withColumn("class", F.coalesce("component", "rid"))
    named = durable(named.select("doc_id", F.col("n").alias("n_shingles"), "rid", "class"), "named")
    counts = _link_counts(named, signed, texts, k, threshold) if count else None
    drop(whole, final)
    least = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least_id"))
    members_out = named.join(least, "class", "left").select("doc_id", "n_shingles", "rid", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))
    if counts is None:
        return members_out, spanning
    copies = named.where("rid is not null").groupBy("rid").agg(F.count("*").alias("copies"))
    linked = F.coalesce("n_docs", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    told = members_out.join(copies, "rid", "left").join(counts, "rid", "left")
    return told.select("doc_id", "n_shingles", "rid", "component_id", linked.alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts")), spanning


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each component (the least id), all columns kept.

    Rows that share an id stay or go together (they stay if one of them is its component's least), equal ones once. Rows with
    a null id and documents without shingles stay.
    """
    members, _ = ngram_join(docs, id_col, text_col, **how)
    by_id = members.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    by_id = durable(by_id.where("rows > 1 or not stays"), "decisions")
    few = lambda df: F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df
    gone = few(by_id.where("not stays").select(F.col("doc_id").alias(id_col)))
    twice = by_id.where("stays").select(F.col("doc_id").alias(id_col))
    left = docs.join(gone, id_col, "left_anti")
    if not twice.limit(1).count():
        return left.select(docs.columns)
    single, several = left.join(few(twice), id_col, "left_anti"), left.join(few(twice), id_col, "left_semi")
    return single.select(docs.columns).unionByName(several.select(docs.columns).dropDuplicates())
