"""Entity resolution of free-text team names against the known names.

The fuzzy step compares every unmatched name with every known name by three tests.
Each test is rewritten as an equi join, so no name pair that fails is ever formed:

* same letters and digits          -> join on the compacted text
* a known name continues the text  -> join on the prefixes of the known name that end
                                      before a space or bracket
* a known name inside the text     -> join on the rarest word of the known name, then a
                                      look at the few texts that have that word

A text that holds a name between word boundaries holds each word of the name as a word of its own.
So known names are indexed by one word each, that which fewest names share, and a text is looked
up by its words: the work grows with the length of the texts and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens import config
from courtlens.functions import text as T
from courtlens.operators.joins import checked_broadcast
from courtlens.session import stable


def _alias_map():
    return F.str_to_map(
        F.lit("|".join(f"{k}={v}" for k, v in config.TEAM_ALIASES.items())), F.lit(r"\|"), F.lit("=")
    )


def _boundary_prefixes(teams: DataFrame) -> DataFrame:
    n = F.length("team_clean")
    at = F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.substring(F.col("team_clean"), i, F.lit(1)).isin(" ", "("),
    )
    return teams.select("team_clean", F.explode(at).alias("i")).select(
        F.expr("substring(team_clean, 1, i - 1)").alias("name"), "team_clean"
    )


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def name_index(teams: DataFrame) -> DataFrame:
    """(word, team_clean): every known name under its rarest word, names without a word under their first sign."""
    name = F.col("team_clean")
    words = _found(name, r"\w+")
    listed = teams.select(name, F.explode(words).alias("word"))
    shared = listed.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    by_word = listed.join(shared, "word").groupBy("team_clean").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    by_sign = teams.where((F.length(name) > 0) & (F.size(words) == 0)).select(name, F.substring(name, 1, 1).alias("word"))
    return by_word.unionByName(by_sign).select("word", "team_clean")


def inside_hits(names: DataFrame, teams: DataFrame) -> DataFrame:
    """Distinct (name, team_clean) where the known name stands in the text between word boundaries.

    Only a hash of the text travels with its words; the texts come back for the candidates, where the names are
    looked for, so texts that share a hash do no harm.
    """
    text = F.col("name")
    named = names.select(text, F.xxhash64(text).alias("h"))
    words = named.select("h", F.explode(F.concat(_found(text, r"\w+"), _found(text, r"\W"))).alias("word"))
    candidates = words.join(checked_broadcast(stable(name_index(teams))), "word").select("h", "team_clean").distinct()
    bounded = F.concat(F.lit(r"(\A|\W)\Q"), F.col("team_clean"), F.lit(r"\E(\W|\z)"))
    return named.join(candidates, "h").where(F.regexp_like(text, bounded)).select("name", "team_clean").distinct()


def fuzzy_hits(names: DataFrame, teams: DataFrame) -> DataFrame:
    """Distinct (name, team_clean) pairs that pass at least one of the three tests.

    The known names, where few, are the side that is broadcast, so the texts stay spread over all tasks; a word
    that all texts share would else send them to one.
    """
    t = stable(teams.select("team_clean").distinct())
    same = names.withColumn("k", T.compact(F.col("name"))).join(
        checked_broadcast(t.withColumn("k", T.compact(F.col("team_clean")))), "k"
    ).select("name", "team_clean")
    longer = names.join(checked_broadcast(_boundary_prefixes(t)), "name").select("name", "team_clean")
    inside = inside_hits(names, t)
    return same.unionByName(longer).unionByName(inside).distinct()


def name_map(raw: DataFrame, teams: DataFrame, use_aliases: bool = True) -> DataFrame:
    """(raw, canonical) for each distinct raw text in column ``raw``.

    Order of preference: manual alias, exact known name, the only fuzzy hit, the
    cleaned text itself. The facts are read once, for their distinct texts; everything
    else works on that list.
    """
    known = teams.select("team_clean").distinct()
    alias = F.element_at(_alias_map(), F.col("name")) if use_aliases else F.lit(None).cast("string")
    exact = checked_broadcast(known.select(F.col("team_clean").alias("name"), F.lit(True).alias("exact")))
    marked = stable(
        raw.select("raw").distinct()
        .withColumn("name", T.strip_opponent_noise(F.col("raw")))
        .withColumn("alias", alias)
        .join(exact, "name", "left")
        .select("raw", "name", F.coalesce("alias", F.when(F.col("exact"), F.col("name"))).alias("sure"))
    )
    unsure = marked.filter(F.col("sure").isNull()).select("name").distinct()
    if unsure.isEmpty():
        return marked.select("raw", F.col("sure").alias("canonical"))
    unique = (
        fuzzy_hits(unsure, known)
        .groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("team_clean").alias("fuzzy"))
        .filter("n = 1").drop("n")
    )
    return marked.join(unique, "name", "left").select(
        "raw", F.coalesce("sure", "fuzzy", "name").alias("canonical")
    )


def resolve(df: DataFrame, columns: dict[str, str], teams: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Add the canonical name of each raw team column (out -> source).

    The distinct texts are read from ``source``, which must hold every text of ``df``; give
    the scan that ``df`` comes from, so that what ``df`` costs is not spent twice.

    Every distinct raw text is cleaned and matched once; the resulting map is small
    next to the facts and comes back by a size-checked broadcast join.
    """
    texts = (source or df).select(F.explode(F.array(*[
        F.coalesce(F.col(s), F.lit("")) for s in columns.values()
    ])).alias("raw")).distinct()
    mapping = stable(name_map(texts, teams))
    small = checked_broadcast(mapping)
    for out, source in columns.items():
        key = F.coalesce(F.col(source), F.lit("")).alias("__raw")
        df = df.withColumn("__raw", key).join(
            small.select(F.col("raw").alias("__raw"), F.col("canonical").alias(out)), "__raw", "left"
        ).drop("__raw")
    return df
