"""Phone numbers of a text by region, in international form, as a column of built-in functions.

A number is read as international behind + or 00, else as one of the region: a trunk prefix is dropped, the rest must have the region's number of digits. How the
digits are grouped behind the country's code is the region's usual way where it is known here, else they stand together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country code, digits of a national number (least, most), trunk prefix, and the sizes of the groups in which ten-digit numbers are written.
REGIONS = {
    "AE": ("971", 8, 9, "0", ""), "AU": ("61", 9, 9, "0", ""), "BR": ("55", 10, 11, "0", ""), "CA": ("1", 10, 10, "1", "3-3-4"), "CH": ("41", 9, 9, "0", ""), "CN": ("86", 10, 11, "0", ""),
    "DE": ("49", 6, 11, "0", ""), "ES": ("34", 9, 9, "", ""), "FR": ("33", 9, 9, "0", ""), "GB": ("44", 9, 10, "0", ""), "IN": ("91", 10, 10, "0", "5 5"), "IT": ("39", 8, 11, "", ""),
    "JP": ("81", 9, 10, "0", ""), "NL": ("31", 9, 9, "0", ""), "NP": ("977", 8, 10, "0", ""), "PK": ("92", 9, 10, "0", ""), "SG": ("65", 8, 8, "", ""), "US": ("1", 10, 10, "1", "3-3-4"), "ZA": ("27", 9, 9, "0", ""),
}
#: What may be a number: digits with usual marks between them, no letters or digits around.
CANDIDATE = r"(?<![\p{L}\p{N}+.])(\+?\(?\d[\d\s().\-/]{5,18}\d)(?![\p{L}\p{N}])"


def _grouped(digits: Column, groups: str) -> Column:
    """Ten digits in groups, as '5 5' or '3-3-4'; others together."""
    if not groups:
        return digits
    sep, at, parts = " " if " " in groups else "-", 1, []
    for n in map(int, groups.split(sep)):
        parts.append(F.substring(digits, at, n))
        at += n
    return F.when(F.length(digits) == at - 1, F.concat_ws(sep, *parts)).otherwise(digits)


def _fits(digits: Column, region: str) -> Column:
    _, least, most, _, _ = REGIONS[region]
    return F.length(digits).between(least, most) & ~digits.startswith("0")


def _international(digits: Column) -> Column:
    """A number behind its country's code; null where no known region's fits. Of regions with one code the first is taken."""
    out = F.lit(None).cast("string")
    for region, (code, _, _, _, groups) in reversed(REGIONS.items()):
        rest = F.substring(digits, len(code) + 1, 20)
        out = F.when(digits.startswith(code) & _fits(rest, region), F.concat(F.lit(f"+{code} "), _grouped(rest, groups))).otherwise(out)
    return out


def _national(digits: Column, region: str) -> Column:
    code, _, _, trunk, groups = REGIONS[region]
    told = lambda d: F.when(_fits(d, region), F.concat(F.lit(f"+{code} "), _grouped(d, groups)))
    bare = F.when(digits.startswith(trunk), F.substring(digits, len(trunk) + 1, 20)) if trunk else F.lit(None).cast("string")
    return F.coalesce(told(digits), told(bare))


def numbers(text: Column, region: str = "IN") -> Column:
    """All phone numbers of a text in international form, in order."""

    def one(raw: Column) -> Column:
        digits = F.regexp_replace(raw, r"\D", "")
        abroad = F.when(F.ltrim(raw).startswith("+"), digits).when(digits.startswith("00"), F.substring(digits, 3, 20))
        return F.when(abroad.isNotNull(), _international(abroad)).otherwise(_national(digits, region))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(1)), one), lambda n: n.isNotNull())


def phone(text: Column, region: str = "IN") -> Column:
    """The first phone number of a text in international form; null without one."""
    return F.get(numbers(text, region), F.lit(0))
