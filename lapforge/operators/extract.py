"""Facts from text and HTML columns, one row per fact, with built-in expressions only.

Patterns ignore case; letters and digits are ASCII. Texts are always read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge import constants as k
from lapforge.functions.scalar import format_lap_time, parse_lap_time
from lapforge.operators.resolve import clean_name, driver_code, team_in_text


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def _guard(text: Column, pattern: str, flags: str, found: Column, empty: Column) -> Column:
    """`found` where the text holds what the pattern needs, looked for with the same flags."""
    need = k.PATTERN_NEEDS.get(pattern)
    return found if need is None else F.when(text.rlike(f"(?{flags}){need}"), found).otherwise(empty)


def find_all(text: Column, pattern: str, flags: str = "i") -> Column:
    """All matches: the first group, or the whole match for a pattern without groups."""
    group = min(_groups(pattern), 1)
    found = F.regexp_extract_all(text, F.lit(f"(?{flags}){pattern}"), F.lit(group))
    return _guard(text, pattern, flags, found, F.array().cast("array<string>"))


def find_rows(text: Column, pattern: str, flags: str = "im") -> Column:
    """All matches as arrays of their groups: one pass over the text, then each match alone."""
    whole = f"(?{flags}){pattern}"
    found = F.regexp_extract_all(text, F.lit(whole), F.lit(0))
    return F.transform(
        found, lambda m: F.array(*[F.regexp_extract(m, whole, i) for i in range(1, _groups(pattern) + 1)])
    )


def first_match(text: Column, patterns: Sequence[str], group: int = 1, flags: str = "i") -> Column:
    """The group of the first pattern that matches, NULL if none does."""
    hits = []
    for p in patterns:
        hit = F.nullif(F.regexp_extract(text, f"(?{flags}){p}", min(group, _groups(p))), F.lit(""))
        hits.append(_guard(text, p, flags, hit, F.lit(None).cast("string")))
    return F.coalesce(*hits)


def _plain_text(cell: Column) -> Column:
    """Text of an HTML fragment: tags and the space around them go, entities are decoded."""
    text = F.trim(F.regexp_replace(cell, r"\s*<[^>]*>\s*", ""))
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def html_cells(pages: DataFrame, row_tag: str = "tr", cell_tags: str = "td|th", key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per HTML row with its cells as plain text; `row` counts from 0."""
    rows = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{row_tag})\b[^>]*>(.*?)</(?:{row_tag})>"), F.lit(1))
    cells = F.regexp_extract_all("__row", F.lit(rf"(?is)<(?:{cell_tags})\b[^>]*>(.*?)</(?:{cell_tags})>"), F.lit(1))
    return pages.select(key, F.posexplode(rows).alias("row", "__row")).select(
        key, "row", F.transform(cells, _plain_text).alias("cells")
    )


def extract_html_rows(pages: DataFrame, key: str = "page_id", html: str = "html", min_cells: int = 7) -> DataFrame:
    """Typed result rows of a page's table: header skipped, enough cells, numeric position."""
    cell = lambda i: F.try_element_at("cells", F.lit(i))
    rows = html_cells(pages, key=key, html=html).filter((F.col("row") > 0) & (F.size("cells") >= min_cells))
    rows = rows.filter(cell(1).rlike(r"^\d+$") & (cell(3) != ""))
    rows = rows.select(
        key,
        cell(1).try_cast("int").alias("position"),
        cell(2).alias("number"),
        cell(3).alias("driver_cell"),
        cell(4).alias("team"),
        cell(5).alias("q1"),
        cell(6).alias("q2"),
        cell(7).alias("q3"),
    )
    return split_code(rows.withColumn("time", best_time(F.col("q1"), F.col("q2"), F.col("q3"))))


def best_time(q1: Column, q2: Column, q3: Column) -> Column:
    """The time of the last session that has one."""
    timed = lambda c: F.when(F.contains(c, F.lit(":")) & ~F.contains(c, F.lit("NC")), c)
    return F.coalesce(timed(q3), timed(q2), timed(q1), F.lit(""))


def split_code(df: DataFrame, col: str = "driver_cell") -> DataFrame:
    """Split the trailing three characters off a name; capitals are a code for sure."""
    c = F.col(col)
    size = F.length(c)
    long = size > 3
    head = F.substring(c, F.lit(1), F.greatest(size - 3, F.lit(0)))
    coded = c.rlike("[A-Z]{3}$")
    name = F.when(size < 3, c).when(coded, F.trim(head)).when(long, head).otherwise(c)
    return df.withColumns(
        {"driver": name, "driver_code": F.when(size < 3, c).otherwise(F.right(c, F.lit(3)))}
    ).drop(col)


def pole_rows(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """The first-placed row of each page."""
    pole = rows.filter(F.col("position") == 1)
    return pole.select(key, F.col("driver").alias("pole_position"), F.col("time").alias("pole_time"))


def grid_slots(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Grid slot per page and driver code; the last row of a code counts."""
    coded = rows.filter(F.col("driver_code") != "")
    return coded.groupBy(key, "driver_code").agg(F.max("position").alias("grid_position"))


def _cascade(steps: Sequence[Callable[[Column], Column]], enough: int, row_type: str) -> Column:
    """Rows of each step in turn until `enough` have come together.

    A step gets the rows so far and adds positions not found yet. Later steps are only
    evaluated on texts that need them.
    """

    def merge(rows: Column, i: Column) -> Column:
        more = F.when(i == 0, steps[0](rows))
        for number, step in enumerate(steps[1:], 1):
            more = more.when(i == number, step(rows))
        new = F.filter(more, lambda r: ~F.exists(rows, lambda old: old["position"] == r["position"]))
        return F.when(F.size(rows) >= enough, rows).otherwise(F.concat(rows, new))

    turns = F.sequence(F.lit(0), F.lit(len(steps) - 1))
    return F.aggregate(turns, F.array().cast(f"array<struct<{row_type}>>"), merge)


def _placed(position: Column, places: int | None) -> Column:
    """Whether a position counts: from 1, up to `places` where that is given."""
    return position >= 1 if places is None else position.between(1, places)


def _top(rows: Column, limit: int | None) -> Column:
    """The first `limit` rows, all without one."""
    return rows if limit is None else F.slice(rows, 1, limit)


def _digits(c: Column) -> Column:
    return c.rlike(r"^\d+$")


def driver_standings(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_matches: int = 10, limit: int | None = None, places: int | None = None
) -> DataFrame:
    """Driver standings lines: patterns in turn until ten valid rows have come together.

    `places` is the last position that counts and `limit` the most valid rows a pattern may
    give; by default there is neither, and texts of any length are read.
    """

    def parsed(m: Column) -> Column:
        rest = F.slice(m, 3, F.size(m) - 2)
        is_code = lambda x: x.rlike("^[A-Z]{3}$")
        hint = "(?i)" + "|".join(k.TEAM_HINTS)
        code = F.try_element_at(F.filter(rest, is_code), F.lit(-1))
        team = F.try_element_at(F.filter(rest, lambda x: ~is_code(x) & x.rlike(hint)), F.lit(-1))
        name = clean_name(F.element_at(m, 2))
        return F.struct(
            F.element_at(m, 1).try_cast("int").alias("position"),
            name.alias("name"),
            F.coalesce(code, driver_code(name)).alias("code"),
            F.try_element_at(F.filter(m, _digits), F.lit(-1)).try_cast("int").alias("points"),
            F.coalesce(team_in_text(team), F.lit("Unknown")).alias("team"),
        )

    def valid(r: Column) -> Column:
        return _placed(r["position"], places) & (r["points"] >= 0) & (r["name"] != "Unknown")

    body = F.col(text)
    per_pattern = [
        lambda _, p=p: _top(F.filter(F.transform(find_rows(body, p), parsed), valid), limit)
        for p in k.DRIVER_STANDING_PATTERNS
    ]
    kind = "position:int,name:string,code:string,points:int,team:string"
    found = docs.select(key, _cascade(per_pattern, min_matches, kind).alias("__rows"))
    return found.select(key, (F.size("__rows") >= min_matches).alias("complete"), F.inline("__rows"))


def team_standings(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_matches: int = 5, limit: int | None = None, places: int | None = None
) -> DataFrame:
    """Constructor standings lines: patterns in turn until five valid rows have come together;
    `limit` and `places` as for drivers."""

    def row(position: Column, team: Column, points: Column) -> Column:
        return F.struct(
            position.try_cast("int").alias("position"),
            team_in_text(team).alias("team"),
            points.try_cast("int").alias("points"),
        )

    def valid(r: Column) -> Column:
        return _placed(r["position"], places) & (r["points"] >= 0)

    def placed(pattern: str) -> Column:
        found = find_rows(F.col(text), pattern)
        return _top(F.filter(F.transform(found, lambda m: row(m[0], m[1], m[2])), valid), limit)

    def listed(rows: Column) -> Column:
        # Lines without a position are numbered on from the rows already found.
        found = find_rows(F.col(text), k.TEAM_STANDING_PATTERNS[2])
        numbered = lambda m, i: row((F.size(rows) + i + 1).cast("string"), m[0], m[1])
        return _top(F.filter(F.transform(found, numbered), valid), limit)

    steps = [lambda _: placed(k.TEAM_STANDING_PATTERNS[0]), lambda _: placed(k.TEAM_STANDING_PATTERNS[1]), listed]
    rows = _cascade(steps, min_matches, "position:int,team:string,points:int")
    return docs.select(key, F.inline(rows))


def _with(columns: Callable[[Column], list[Column]], **fixed: str) -> Callable[[Column], Column]:
    """A function from an array's element to a struct of its columns and fixed values."""
    return lambda element: F.struct(*columns(element), *[F.lit(v).alias(n) for n, v in fixed.items()])


def extract_pole(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: Sequence[str] = k.POLE_PATTERNS) -> DataFrame:
    """Pole driver and time by the first pattern that matches."""
    body = F.col(text)
    return docs.select(
        key,
        clean_name(first_match(body, patterns, 1, "is")).alias("pole_driver"),
        first_match(body, patterns, 2, "is").alias("pole_time"),
    ).filter(F.col("pole_time").isNotNull())


def short_pole(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pole driver and time where both stand in one line: two words and a time around the words
    pole position, or behind the first place."""
    body = F.col(text)
    return docs.select(
        key,
        F.trim(first_match(body, k.POLE_SHORT_PATTERNS, 1)).alias("pole_driver"),
        first_match(body, k.POLE_SHORT_PATTERNS, 2).alias("pole_time"),
    ).filter(F.col("pole_time").isNotNull())


def impute_times(df: DataFrame, pole_time: str = "pole_time", time: str = "time") -> DataFrame:
    """Fill missing times with a tenth per place behind the pole time."""
    guess = format_lap_time(parse_lap_time(F.col(pole_time)) + (F.col("position") - 1) * 0.1)
    return df.withColumn(time, F.coalesce(F.nullif(F.col(time), F.lit("")), guess))


def _mentions(text: Column, patterns: Sequence[str], longer_than: int = 0) -> Column:
    found = F.transform(F.concat(*[find_all(text, p) for p in patterns]), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.filter(found, lambda x: F.length(x) > longer_than)


def weather_phrase(text: Column) -> Column:
    """The first weather phrase of more than three letters."""
    hits = []
    for p in k.WEATHER_PATTERNS:
        hit = F.trim(F.regexp_extract(text, f"(?i){p}", 1))
        hits.append(F.when(F.length(hit) > 3, hit))
    return F.coalesce(*hits)


def incidents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct penalty and incident names per document."""
    names = F.array_distinct(_mentions(F.col(text), k.INCIDENT_PATTERNS, 2))
    return docs.select(key, F.explode(names).alias("mention"))


def race_reports(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Weather phrase and, for finished races, the winner of each document."""
    body = F.col(text)
    over = body.rlike("(?i)concluded|finished")
    winner = clean_name(first_match(body, k.WINNER_PATTERNS))
    return docs.select(
        key,
        weather_phrase(body).alias("weather"),
        F.when(over & (winner != "Unknown"), winner).alias("winner"),
    ).filter(F.col("weather").isNotNull() | F.col("winner").isNotNull())


def _codes(text: str, patterns: Sequence[str], distinct: bool) -> Column:
    codes = F.filter(F.transform(_mentions(F.col(text), patterns), F.upper), lambda x: F.length(x) == 3)
    return F.array_distinct(codes) if distinct else codes


def code_mentions(docs: DataFrame, patterns: Sequence[str], key: str = "doc_id", text: str = "text", distinct: bool = True) -> DataFrame:
    """Three-letter codes named by any pattern, each once per document unless told otherwise."""
    return docs.select(key, F.explode(_codes(text, patterns, distinct)).alias("code"))


def form_mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Drivers in form, struggling, and circuit specialists named in a document, in one scan."""
    kinds = {
        "in_form": (k.IN_FORM_PATTERNS, True),
        "struggling": (k.STRUGGLING_PATTERNS, True),
        "specialist": (k.SPECIALIST_PATTERNS, False),
    }
    tagged = [
        F.transform(_codes(text, p, once), _with(lambda c: [c.alias("code")], kind=kind))
        for kind, (p, once) in kinds.items()
    ]
    return docs.select(key, F.inline(F.concat(*tagged)))


def update_mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Driver changes and technical updates with their fixed impact, in one scan."""
    kinds = {"driver_change": (k.DRIVER_CHANGE_PATTERNS, "medium"), "technical_update": (k.TECH_UPDATE_PATTERNS, "positive")}
    tagged = [
        F.transform(_mentions(F.col(text), p), _with(lambda x: [x.alias("description")], kind=kind, impact=impact))
        for kind, (p, impact) in kinds.items()
    ]
    return docs.select(key, F.inline(F.concat(*tagged)))


def extract_int(docs: DataFrame, patterns: Sequence[str] = k.RACES_COMPLETED_PATTERNS, key: str = "doc_id", text: str = "text", name: str = "races_completed") -> DataFrame:
    """The number found by the first matching pattern, 0 if none matches."""
    number = first_match(F.col(text), patterns).try_cast("int")
    return docs.select(key, F.coalesce(number, F.lit(0)).alias(name))


def flag_unsafe_sql(df: DataFrame, col: str) -> DataFrame:
    """Add `is_read_only`: the statement starts with SELECT or WITH and has no forbidden word."""
    bare = F.upper(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))
    bare = F.regexp_replace(bare, r"--.*?\n", "")
    bare = F.regexp_replace(bare, r"(?s)/\*.*?\*/", "")
    first = F.regexp_extract(bare, r"^\s*(\S+)", 1)
    bad = bare.rlike(r"\b(?:" + "|".join(k.FORBIDDEN_SQL) + r")\b")
    return df.withColumn("is_read_only", F.coalesce(first.isin("SELECT", "WITH") & ~bad, F.lit(False)))
