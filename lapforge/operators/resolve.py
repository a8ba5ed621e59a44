"""Names: resolving free spellings to dimension keys, codes and canonical forms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge import constants as k
from lapforge.functions.scalar import tier
from lapforge.operators.groups import contains_join, held_join, top_n
from lapforge.operators.scoring import simple_form


def alias_table(dim: DataFrame, key: str, names: str) -> DataFrame:
    """One row per key and lower-case alias, with the usual spellings of each name."""
    plain = dim.select(F.col(key), F.explode(names).alias("__n")).withColumn("__n", F.lower(F.trim("__n")))
    n = F.col("__n")
    spellings = F.array(
        n,
        F.replace(n, F.lit(" "), F.lit("")),
        F.replace(n, F.lit("-"), F.lit(" ")),
        F.concat(n, F.lit(" grand prix")),
        F.concat(n, F.lit(" gp")),
    )
    return plain.select(key, F.explode(F.array_distinct(spellings)).alias("alias")).distinct()


def resolve_names(df: DataFrame, col: str, aliases: DataFrame, key: str, name: str = "resolved_key") -> DataFrame:
    """Add the key whose alias equals the name, else contains it or is contained in it.

    `aliases` has `key` and a lower-case `alias`. Among several, the longest alias and
    then the lowest key wins. Only distinct names are matched.
    """
    names = (
        df.select(F.lower(F.trim(col)).alias("__name")).filter(F.length("__name") > 0).distinct()
    )
    table = aliases.select(F.col(key).alias("__key"), F.col("alias").alias("__alias"))
    pairs = contains_join(names, table, "__name", "__alias")
    order = [
        (F.col("__name") != F.col("__alias")).cast("int"),
        F.length("__alias").desc(),
        F.col("__key"),
    ]
    best = top_n(pairs, ["__name"], order, 1).select("__name", F.col("__key").alias(name))
    return df.withColumn("__name", F.lower(F.trim(col))).join(best, "__name", "left").drop("__name")


def suggest_names(df: DataFrame, col: str, dim: DataFrame, title: str, n: int = 5) -> DataFrame:
    """Up to `n` titles per distinct name that share a word with it, either way round.

    `dim` has `title` and a lower-case `alias`. A word counts when it occurs anywhere
    in the other text. Titles come in alphabetical order.
    """
    names = df.select(F.lower(col).alias("name")).filter(F.length("name") > 0).distinct()
    table = dim.select(F.col(title).alias("suggestion"), "alias").distinct()
    word = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != "")))
    left = names.withColumn("__w", word("name"))
    right = table.withColumn("__w", word("alias"))
    # A word of the name inside the alias, or a word of the alias inside the name.
    forward = contains_join(left, table, "__w", "alias").filter(F.contains("alias", "__w"))
    backward = contains_join(names, right, "name", "__w").filter(F.contains("name", "__w"))
    hits = forward.select("name", "suggestion").unionByName(backward.select("name", "suggestion")).distinct()
    return top_n(hits, ["name"], [F.col("suggestion")], n, "place")


def list_circuits(dim: DataFrame, names: str = "official_names") -> DataFrame:
    """First official name of every circuit, sorted."""
    first = F.try_element_at(names, F.lit(1))
    return dim.select(first.alias("name")).filter(F.col("name").isNotNull()).orderBy("name")


def _lookup(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def first_names(df: DataFrame, key: str, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """Add `name`: the full spelling of the first known name inside each text, ignoring case.

    `names` holds (known, full, rank), any number of rows; the least rank counts. Texts and names meet
    through an index of grams, so the cost does not go with their number. `key` names the rows of `df`.
    """
    texts = df.select(F.col(key).alias("__key"), F.lower(text).alias("__text"))
    known = names.select(F.lower("known").alias("__known"), F.struct("rank", "full").alias("__name"))
    held = held_join(texts, known, "__text", "__known").groupBy("__key").agg(F.min("__name")["full"].alias(name))
    return df.drop(name).join(held, df[key] == held["__key"], "left").drop("__key")


def driver_code(name: Column, table: Mapping[str, str] = k.DRIVER_CODES) -> Column:
    """Three-letter code: kept if it is one, else known by name, else from the last name."""
    trimmed = F.trim(name)
    parts = F.split(trimmed, r"\s+")
    several = F.size(parts) >= 2
    made = F.rpad(
        F.upper(F.substring(F.when(several, F.element_at(parts, -1)).otherwise(name), 1, 3)), 3, "X"
    )
    kept = F.when(F.upper(trimmed).rlike("^[A-Z]{3}$"), F.upper(trimmed))
    known = F.try_element_at(_lookup(table), F.lower(trimmed))
    return F.when(F.coalesce(name, F.lit("")) == "", "").otherwise(F.coalesce(kept, known, made))


def team_name(name: Column, table: Mapping[str, str] = k.TEAM_NAMES) -> Column:
    """Team spelling from the exact table, else in title case; Unknown if empty."""
    known = F.try_element_at(_lookup(table), F.lower(F.trim(name)))
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(F.coalesce(known, F.initcap(name)))


def _first_word(text: Column, table: Mapping[str, str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(word)), full) for word, full in table.items()])


def team_in_text(name: Column, table: Mapping[str, str] = k.TEAM_WORDS) -> Column:
    """Team spelling by the first known word inside the text, else in title case."""
    tidy = F.trim(F.regexp_replace(name, r"\s+", " "))
    found = F.coalesce(_first_word(F.lower(tidy), table), F.initcap(tidy))
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(found)


def clean_name(name: Column) -> Column:
    """Title-case name without doubled spaces or a leading position."""
    tidy = F.trim(F.regexp_replace(name, r"\s+", " "))
    bare = F.regexp_replace(tidy, r"(?i)^(P\d+:?|Position\s+\d+:?)", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(F.initcap(bare))


def standard_gp_name(name: Column, table: Mapping[str, str] = k.GP_WORDS) -> Column:
    """Full grand prix name by the first known word, else the name completed."""
    short = F.replace(F.replace(name, F.lit("Grand Prix"), F.lit("GP")), F.lit("grand prix"), F.lit("GP"))
    lower = F.lower(short)
    named = F.contains(lower, F.lit("grand prix")) | F.contains(lower, F.lit("gp"))
    complete = F.when(named, short).otherwise(F.concat(short, F.lit(" Grand Prix")))
    return F.coalesce(_first_word(F.trim(lower), table), complete)


def process_standings(df: DataFrame, name: str = "driver_name") -> DataFrame:
    """Standings with normalized code and team, form score and performance tier."""
    return df.withColumns(
        {
            "code": driver_code(F.col(name)),
            "team": team_name(F.col("team")),
            "points": F.col("points").cast("double"),
            "form_score": simple_form(F.col("position")),
            "performance_tier": tier(F.col("position")),
        }
    )
