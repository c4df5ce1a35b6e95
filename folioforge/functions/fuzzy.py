"""Fuzzy similarity of token sets, as a column of built-in functions and as a plain function of two texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_WORD = re.compile(r"[^a-z0-9]+")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def token_set_ratio(left: str, right: str) -> int:
    """0 to 100: likeness of the sorted distinct tokens, where a subset is a full match."""
    x, y = (set(_NOT_WORD.sub(" ", t.lower()).split()) for t in (left, right))
    if not x or not y:
        return 0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 100
    s, p, q = len(both), len(only_x), len(only_y)
    long_x, long_y = s + (s > 0) + p, s + (s > 0) + q
    best = 1 - (p + q - 2 * _lcs(only_x, only_y)) / (long_x + long_y)
    if s:
        best = max(best, 1 - (1 + p) / (s + long_x), 1 - (1 + q) / (s + long_y))
    return round(100 * best)


#: Bits of a long that hold places of a text; the rest is room for a carry.
_BITS = 60
_FULL = (1 << _BITS) - 1


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", _long(1), n)


def _masks(chars: Column, first: Column, last: Column) -> Column:
    """Each character's places among chars[first ... last] as the bits of a long."""
    bit = lambda c: lambda acc, i: F.when(chars[i] == c, acc.bitwiseOR(_bit(i - first))).otherwise(acc)
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, F.aggregate(F.sequence(first, last), _long(0), bit(c)))))


def _low(n: Column) -> Column:
    """A long whose n lowest bits are set."""
    return _bit(n) - 1


def lcs_column(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two texts that aren't empty: bit-parallel, a step for each character of the longer one. Places of
    the shorter one are the bits of one long, or of several with a carry between them."""
    shorter, longer = F.when(F.length(left) <= F.length(right), left).otherwise(right), F.when(F.length(left) <= F.length(right), right).otherwise(left)
    chars = F.split(shorter, "")

    def one(a: Column, b: Column) -> Column:
        # Each character of b becomes the places where a has it; a step is then a few operations on longs.
        letters = F.array_distinct(a)
        bit = lambda c: lambda acc, i: F.when(a[i] == c, acc.bitwiseOR(_bit(i))).otherwise(acc)
        places = F.array_prepend(F.transform(letters, lambda c: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), _long(0), bit(c))), _long(0))
        step = lambda row, m: (row + row.bitwiseAND(m)).bitwiseAND(_long(_FULL)).bitwiseOR(row.bitwiseAND(F.bitwise_not(m)))
        of = lambda t: F.transform(b, lambda c: F.get(t["places"], F.call_function("locate", c, t["letters"])))
        known = F.struct(F.array_join(letters, "").alias("letters"), places.alias("places"))
        return _let(known, lambda t: F.aggregate(of(t), _low(F.size(a)), step, lambda row: F.size(a) - F.bit_count(row.bitwiseAND(_low(F.size(a))))))

    def several(a: Column, b: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BITS).cast("int"))
        width = lambda p: F.least(F.lit(_BITS), F.size(a) - p * _BITS)
        masks = F.transform(parts, lambda p: _masks(a, p * _BITS, p * _BITS + width(p) - 1))

        def step(ms: Column) -> Callable[[Column, Column], Column]:
            def limb(rows: Column, c: Column) -> Callable[[Column, Column], Column]:
                def add(acc: Column, p: Column) -> Column:
                    row = rows[p]
                    u = row.bitwiseAND(F.coalesce(ms[p][c], _long(0)))
                    return _let(F.struct(u.alias("u"), (row + u + acc["carry"]).alias("sum")), lambda x: F.struct(
                        F.array_append(acc["out"], x["sum"].bitwiseAND(_long(_FULL)).bitwiseOR(row.bitwiseAND(F.bitwise_not(x["u"])))).alias("out"), F.shiftright(x["sum"], _BITS).alias("carry")
                    ))

                return add

            start = F.struct(F.array().cast("array<bigint>").alias("out"), _long(0).alias("carry"))
            return lambda rows, c: F.aggregate(parts, start, limb(rows, c), lambda acc: acc["out"])

        held = lambda rows: F.aggregate(parts, F.lit(0), lambda n, p: n + F.bit_count(rows[p].bitwiseAND(_low(width(p)))))
        return _let(masks, lambda m: F.aggregate(b, F.transform(parts, lambda p: _low(width(p))), step(m), lambda rows: F.size(a) - held(rows)))

    both = F.struct(chars.alias("a"), F.split(longer, "").alias("b"))
    return _let(both, lambda t: F.when(F.size(t["a"]) <= _BITS, one(t["a"], t["b"])).otherwise(several(t["a"], t["b"])))


def token_set_ratio_column(left: Column, right: Column) -> Column:
    """0 to 1; nulls are empty texts. Sets of which one holds the other need no alignment."""
    tokens = lambda t: F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")))
    joined = lambda c: F.array_join(c, " ")

    def aligned(t: Column) -> Column:
        s, p, q = F.length(t["both"]), F.length(t["x"]), F.length(t["y"])
        gap = F.when(s > 0, 1).otherwise(0)
        whole = lambda common: 1 - (p + q - 2 * common) / (2 * s + 2 * gap + p + q)
        beside = F.when(s > 0, F.greatest(1 - (1 + p) / (2 * s + gap + p), 1 - (1 + q) / (2 * s + gap + q))).otherwise(0.0)
        # A subsequence is no longer than the shorter text: where even that would not be more than the shared words are worth, nothing is aligned.
        best = F.when(whole(F.least(p, q)) <= beside, beside).otherwise(F.greatest(beside, whole(lcs_column(t["x"], t["y"]))))
        return F.bround(100 * best, 0) / 100

    def compared(t: Column) -> Column:
        parts = F.struct(joined(F.array_intersect(t["x"], t["y"])).alias("both"), joined(F.array_except(t["x"], t["y"])).alias("x"), joined(F.array_except(t["y"], t["x"])).alias("y"))
        subset = lambda r: (r["both"] != "") & ((r["x"] == "") | (r["y"] == ""))
        return F.when((F.size(t["x"]) == 0) | (F.size(t["y"]) == 0), 0.0).otherwise(_let(parts, lambda r: F.when(subset(r), 1.0).otherwise(aligned(r))))

    return _let(F.struct(tokens(left).alias("x"), tokens(right).alias("y")), compared)
