"""Names in texts: from lists of known names, by joins of word runs, or from a recogniser of the caller's.

A recogniser is a function from rows (node_id, text) to rows (node_id, kind, name, at); kinds are 'person' and 'institution', at orders the names
of a node. `gazetteer_recogniser` makes one from a table of names; answers and ranking take their results where they are given, and patterns where they aren't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .index import few

Recogniser = Callable[[DataFrame], DataFrame]


def _spaced(t: Column) -> Column:
    """Words with the marks that names hold (& ' . -), in order of the text."""
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+(?:['’.\-][\p{L}\p{N}]+)*|&"), F.lit(0))


def _key(words: Column) -> Column:
    return F.lower(F.array_join(words, " "))


def _runs(m: int) -> Column:
    """(at, m, key) of the runs of m words of column w."""
    starts = F.when(F.size("w") >= m, F.sequence(F.lit(0), F.size("w") - m)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(m).alias("m"), _key(F.slice("w", i + 1, m)).alias("key")))


def find_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(node_id, kind, name, at): the known names (kind, name) that stand in texts (node_id, text), whatever the case and the space between words; of names that
    overlap the one that begins first, the longest of these. at is the number of the first word.

    Runs of as many words as names have meet the names in an equi-join (by broadcast where the names are counted to be few). What is gathered for
    a text are its own matches."""
    known = names.select("kind", "name", _spaced(F.col("name")).alias("w")).where("size(w) > 0").groupBy(_key(F.col("w")).alias("key"), F.size("w").alias("m")).agg(F.min(F.struct("kind", "name")).alias("known"))
    sizes = [r.m for r in known.select("m").distinct().collect()]  # lengths of names in words
    w = texts.select("node_id", _spaced(F.col("text")).alias("w"))
    runs = F.flatten(F.array(*map(_runs, sizes))) if sizes else F.array().cast("array<struct<at:int,m:int,key:string>>")
    met = w.select("node_id", F.explode(runs).alias("r")).select("node_id", "r.*").join(few(known.drop("m")), "key")
    matches = F.array_sort(F.collect_list(F.struct("at", (-F.col("m")).alias("less"), "known")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,kind:string,name:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct((x["at"] - x["less"]).alias("end"), F.array_append(acc["out"], F.struct(x["at"].alias("at"), x["known"]["kind"].alias("kind"), x["known"]["name"].alias("name"))).alias("out"))
        return F.when(x["at"] >= acc["end"], taken).otherwise(acc)

    found = met.groupBy("node_id").agg(matches.alias("x")).select("node_id", F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("e"))
    return found.select("node_id", "e.kind", "e.name", "e.at")


def gazetteer_recogniser(names: DataFrame) -> Recogniser:
    """Known names first, patterns in nodes that hold none of a kind."""

    def recognise(texts: DataFrame) -> DataFrame:
        known = find_names(texts, names)
        guessed = texts.select("node_id", F.explode(F.array(F.struct(F.lit("person").alias("kind"), T.person_name(F.col("text")).alias("name")), F.struct(F.lit("institution").alias("kind"), T.institution(F.col("text")).alias("name")))).alias("g"))
        guessed = guessed.select("node_id", "g.kind", "g.name", F.lit(0).alias("at")).where("name is not null")
        return known.unionByName(guessed.join(known.select("node_id", "kind").distinct(), ["node_id", "kind"], "left_anti"))

    return recognise


def first_names(found: DataFrame) -> DataFrame:
    """(node_id, names): each node's first name of each kind, as a map."""
    first = found.groupBy("node_id", "kind").agg(F.min(F.struct("at", "name")).alias("first"))
    return first.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "first.name"))).alias("names"))
