"""Session results from the free text of weekend reports, by a scan over the lines of a text.

Every line is a heading of a session, a row of a list, or neither. A heading's list reaches to the
next heading, blank line, or line of other words; all its rows count, with or without a time. The
sections of a text lie between one such mark and the next, so one pass over the marks cuts them
and nothing is carried from line to line. A text stays in its row: no shuffle, no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge import constants as k
from lapforge.functions.scalar import format_lap_time, parse_lap_time
from lapforge.operators.extract import find_rows, first_match
from lapforge.operators.resolve import clean_name

QUALIFYING = "Qualifying"
PRACTICES = ("FP1", "FP2", "FP3")
ROW = "position:int,driver:string,time:string"
LINES, MARKS, PARTS = "__lines", "__marks", "__parts"


def _heading(session: str) -> str:
    """One pattern for the headings of a session; group 1 is the rest of the line."""
    forms = k.QUALIFYING_HEADINGS if session == QUALIFYING else k.practice_headings(int(session[2:]))
    return f"(?i)(?:{'|'.join(forms)})(.*)$"


def _mark(line: Column) -> Column:
    """The session that a line opens, '' where it closes what is open, NULL for rows and the rest."""
    opened = F.when(line.rlike(_heading(QUALIFYING)), QUALIFYING)
    for session in PRACTICES:
        opened = opened.when(line.rlike(_heading(session)), session)
    other = (F.trim(line) == "") | line.rlike(r"^\s*[A-Za-z]") & ~line.rlike(k.PLACE_START)
    return opened.when(other, "")


def _rest(line: Column, session: Column) -> Column:
    """What follows the heading on its own line."""
    rest = F.regexp_extract(line, _heading(QUALIFYING), 1)
    for name in PRACTICES:
        rest = F.when(session == name, F.regexp_extract(line, _heading(name), 1)).otherwise(rest)
    return F.when(session == "", line).otherwise(rest)


def _cut(text: str) -> list[tuple[str, Column]]:
    """Columns that cut a text into parts of (session, lines), in steps that build on each other."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    marked = F.transform(F.col(LINES), lambda line, i: F.struct(i.alias("at"), _mark(line).alias("session")))
    # What comes before the first mark belongs to no session.
    start = F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("session")))
    marks = F.concat(start, F.filter(marked, lambda m: m["session"].isNotNull()))

    def part(mark: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col(MARKS), i + 1)["at"], F.size(LINES))
        body = F.slice(F.col(LINES), mark["at"] + 2, end - mark["at"] - 1)
        own = F.when(mark["at"] < 0, F.array().cast("array<string>")).otherwise(
            F.array(_rest(F.get(F.col(LINES), mark["at"]), mark["session"]))
        )
        return F.struct(mark["session"].alias("session"), F.concat(own, body).alias("lines"))

    return [(LINES, lines), (MARKS, marks), (PARTS, F.transform(F.col(MARKS), part))]


def _rows(lines: Column, timed: Sequence[str], untimed: Sequence[str], places: int | None, limit: int | None) -> Column:
    """The rows of a part's lines; a line is read by the first pattern that finds any in it."""

    def row(with_time: bool):
        def made(m: Column) -> Column:
            time = F.element_at(m, -1) if with_time else F.lit("")
            return F.struct(
                m[0].try_cast("int").alias("position"), clean_name(m[1]).alias("driver"), time.alias("time")
            )

        return made

    def of_line(line: Column) -> Column:
        found = None
        for pattern, has_time in [*((p, True) for p in timed), *((p, False) for p in untimed)]:
            rows = F.transform(find_rows(line, pattern), row(has_time))
            hit = F.when(line.rlike(f"(?im){pattern}"), rows)
            found = hit if found is None else F.coalesce(found, hit)
        return F.coalesce(found, F.array().cast(f"array<struct<{ROW}>>"))

    least = lambda r: r["position"] >= 1 if places is None else r["position"].between(1, places)
    rows = F.filter(F.flatten(F.transform(lines, of_line)), lambda r: least(r) & (r["driver"] != ""))
    return rows if limit is None else F.slice(rows, 1, limit)


def _session(name: str, places: int | None, limit: int | None) -> Column:
    """Rows of the first part of a session that has any; a list without heading counts as qualifying."""
    timed = k.GRID_ROW_PATTERNS if name == QUALIFYING else k.PRACTICE_ROW_PATTERNS
    untimed = k.GRID_UNTIMED_PATTERNS if name == QUALIFYING else k.PRACTICE_UNTIMED_PATTERNS
    read = lambda lines: _rows(lines, timed, untimed, places, limit)
    headed = F.filter(PARTS, lambda p: p["session"] == name)
    found = F.filter(F.transform(headed, lambda p: read(p["lines"])), lambda rows: F.size(rows) > 0)
    first = F.get(found, F.lit(0))
    if name != QUALIFYING:
        return first

    def bare(p: Column) -> Column:
        """Lines from the one that opens a list on."""
        opens = F.transform(p["lines"], lambda line: line.rlike(k.BARE_LIST_START))
        at = F.array_position(opens, F.lit(True)).cast("int")
        return F.slice(p["lines"], at, F.size(p["lines"]) - at + 1)

    loose = F.filter(PARTS, lambda p: (p["session"] == "") & F.exists(p["lines"], lambda x: x.rlike(k.BARE_LIST_START)))
    return F.coalesce(first, F.get(F.transform(loose, lambda p: read(bare(p))), F.lit(0)))


def _one(position: int, driver: Column, time: Column) -> Column:
    return F.array(F.struct(F.lit(position).alias("position"), driver.alias("driver"), time.alias("time")))


def _fastest(text: Column, number: int) -> Column:
    """The single line on a session's fastest driver, as a list of one row; NULL without one."""
    hits = []
    for pattern in k.fastest_patterns(number):
        driver, time = (F.regexp_extract(text, f"(?im){pattern}", i) for i in (1, 2))
        hits.append(F.when(time != "", _one(1, clean_name(driver), time)))
    return F.coalesce(*hits)


def weekend_sessions(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int | None = None, places: int | None = None
) -> DataFrame:
    """Rows of qualifying and of the three practice sessions of each report: session, position,
    driver, time, and whether the time is `estimated`.

    Qualifying comes from the first list under a heading that has rows, else from a list without
    heading, else it is the pole alone. Practice comes from a headed list, else from the line on the
    fastest driver. A qualifying row without a time gets the pole's, a tenth later per place. `places`
    is the last position that counts, `limit` the most rows of a list; by default there is neither.
    Null and empty texts give no rows, repeated rows give their rows again.
    """
    df = docs.select(key, F.col(text).alias("__text"))
    body = F.col("__text")
    pole = {
        "__pole": clean_name(first_match(body, k.POLE_PATTERNS, 1, "is")),
        "__pole_time": first_match(body, k.POLE_PATTERNS, 2, "is"),
    }
    df = df.withColumns(pole)
    for name, column in _cut("__text"):
        df = df.withColumn(name, column)
    only_pole = F.when(F.col("__pole_time").isNotNull(), _one(1, F.col("__pole"), F.col("__pole_time")))
    lists = {QUALIFYING: F.coalesce(_session(QUALIFYING, places, limit), only_pole)}
    lists |= {s: F.coalesce(_session(s, places, limit), _fastest(body, i + 1)) for i, s in enumerate(PRACTICES)}
    none = F.array().cast(f"array<struct<session:string,{ROW},estimated:boolean>>")

    def tagged(name: str, rows: Column) -> Column:
        def filled(r: Column) -> Column:
            missing = F.lit(name == QUALIFYING) & (r["time"] == "") & F.col("__pole_time").isNotNull()
            guess = format_lap_time(parse_lap_time(F.col("__pole_time")) + (r["position"] - 1) * 0.1)
            time = F.when(missing, guess).otherwise(r["time"])
            return F.struct(
                F.lit(name).alias("session"), r["position"].alias("position"), r["driver"].alias("driver"),
                time.alias("time"), missing.alias("estimated"),
            )

        return F.coalesce(F.transform(rows, filled), none)

    return df.select(key, F.inline(F.concat(*[tagged(name, rows) for name, rows in lists.items()])))
