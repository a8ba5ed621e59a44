import random

import pytest
from pyspark.sql import functions as F

from lapforge import constants as k
from lapforge.functions import scalar as fn
from lapforge.operators import cleaning as c
from lapforge.operators import extract as x
from lapforge.operators import resolve as r
from lapforge.operators import weather as w
from lapforge.schemas import schema


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    "sql, ok",
    [
        ("SELECT * FROM laps", True),
        ("-- a comment\nWITH a AS (SELECT 1) SELECT * FROM a", True),
        ("INSERT INTO laps VALUES (1)", False),
        ("DROP TABLE laps", False),
        ("SELECT 1; DELETE FROM laps", False),
        ("/* select */ UPDATE laps SET x = 1", False),
        ("SELECT updated_at FROM laps", True),
        ("", False),
    ],
)
def test_read_only_sql(spark, sql, ok):
    df = x.flag_unsafe_sql(spark.createDataFrame([(sql,)], "q string"), "q")
    assert df.collect()[0].is_read_only is ok


@pytest.mark.parametrize(
    "name, code",
    [("VER", "VER"), ("ver", "VER"), ("Max Verstappen", "VER"), ("Nyck de Vries", "DEV"), ("Ann Li", "LIX"), ("Bo", "BOX"), ("", "")],
)
def test_driver_codes(spark, name, code):
    assert value(spark, r.driver_code(F.lit(name))) == code


def test_names(spark):
    assert value(spark, r.team_name(F.lit("scuderia ferrari"))) == "Ferrari"
    assert value(spark, r.team_name(F.lit(""))) == "Unknown"
    assert value(spark, r.team_in_text(F.lit("the  Red Bull  team"))) == "Red Bull Racing"
    assert value(spark, r.clean_name(F.lit("  P1:  max   VERSTAPPEN "))).strip() == "Max Verstappen"
    assert value(spark, r.standard_gp_name(F.lit("Monza"))) == "Italian Grand Prix"
    assert value(spark, r.standard_gp_name(F.lit("Korean"))) == "Korean Grand Prix"
    assert value(spark, r.standard_gp_name(F.lit("Korean Grand Prix"))) == "Korean GP"


def test_lap_time_text(spark):
    assert value(spark, fn.format_lap_time(F.lit(75.372))) == "1:15.372"
    assert value(spark, fn.format_lap_time(F.lit(119.9996))) == "2:00.000"
    assert value(spark, fn.parse_lap_time(F.lit("1:15.372"))) == 75.372
    assert value(spark, fn.parse_lap_time(F.lit("NC"))) is None
    assert [value(spark, fn.ordinal(F.lit(i))) for i in (1, 2, 3, 4, 11, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "21st", "112th"]


def test_resolution_tiers(spark, rows):
    dim = spark.createDataFrame([("hungarian_gp", ["Hungarian", "hungaroring"]), ("italian_gp", ["Italian", "Monza"])], "key string, names array<string>")
    df = spark.createDataFrame([("Hungarian Grand Prix",), ("MONZA",), ("Autodromo di Monza 2024",), ("hungaro",), ("Suzuka",), ("",), (None,)], "n string")
    out = r.resolve_names(df, "n", r.alias_table(dim, "key", "names"), "key")
    assert rows(out, "n", "resolved_key") == rows(
        spark.createDataFrame(
            [("Hungarian Grand Prix", "hungarian_gp"), ("MONZA", "italian_gp"), ("Autodromo di Monza 2024", "italian_gp"), ("hungaro", "hungarian_gp"),
             ("Suzuka", None), ("", None), (None, None)], "n string, k string")
    )


def test_suggestions_share_a_word(spark):
    dim = spark.createDataFrame([("Italian Grand Prix", "monza park"), ("Spanish Grand Prix", "barcelona")], "t string, alias string")
    df = spark.createDataFrame([("royal park",), ("barce",)], "n string")
    out = {(i.name, i.suggestion) for i in r.suggest_names(df, "n", dim, "t").collect()}
    assert out == {("royal park", "Italian Grand Prix"), ("barce", "Spanish Grand Prix")}


def test_sanitize(spark, rows):
    df = spark.createDataFrame(
        [(float("nan"), "7", 1.0), (float("inf"), " 8 ", 0.0), (-2.9, "NC", float("nan")), (2.9, "7.9", None)], "a double, b string, c double"
    ).withColumn("d", F.col("a"))
    out = c.sanitize(df, schema("a:int b:int c:boolean d:double"))
    assert rows(out) == rows(spark.createDataFrame([(None, 7, True, None), (None, 8, False, None), (-2, None, None, -2.9), (2, None, None, 2.9)], "a int, b int, c boolean, d double"))


def test_standings_cascade_goes_on_until_enough(spark):
    first = "\n".join(f"{i}. Ann Lee (ANN) - Ferrari - {300 - i} points" for i in range(1, 4))
    later = "\n".join(f"P{i}: Bob Ray (McLaren) - {200 - i} pts" for i in range(4, 13))
    docs = spark.createDataFrame([("a", first + "\n" + later)], "doc_id string, text string")
    out = x.driver_standings(docs).collect()
    assert {i.complete for i in out} == {True}
    assert {(i.position, i.team) for i in out if i.name == "Ann Lee"} == {(1, "Ferrari"), (2, "Ferrari"), (3, "Ferrari")}
    assert {i.position for i in out if i.name == "Bob Ray"} == set(range(4, 13))


def test_team_lines_without_position_are_numbered(spark, rows):
    docs = spark.createDataFrame([("a", "Constructors today. McLaren: 516 pts, Ferrari: 260 pts, Mercedes: 236 pts")], "doc_id string, text string")
    assert rows(x.team_standings(docs), "position", "team", "points")[0][0] == 1


def test_pole_and_imputed_times(spark):
    docs = spark.createDataFrame([("a", "Pole position: Charles Leclerc (1:15.372) in Q3")], "doc_id string, text string")
    pole = x.extract_pole(docs).collect()[0]
    assert (pole.pole_driver, pole.pole_time) == ("Charles Leclerc", "1:15.372")
    df = spark.createDataFrame([(1, "1:15.372", "1:15.372"), (4, "", "1:15.372")], "position int, time string, pole_time string")
    assert [i.time for i in x.impute_times(df).collect()] == ["1:15.372", "1:15.672"]


def test_free_text_patterns_only_run_where_they_can_match(spark):
    text = "word " * 20000 + "Max received a penalty for contact"
    docs = spark.createDataFrame([("a", "x " * 30000), ("b", text[-400:])], "doc_id string, text string")
    assert {i.doc_id for i in x.incidents(docs).collect()} == {"b"}
    assert x.race_reports(docs).count() == 0


def test_html_rows(spark):
    head = "<tr>" + "<th>h</th>" * 7 + "</tr>"
    row = "<tr><td>1</td><td>16</td><td><span> Charles</span> <span>Leclerc</span><span>LEC</span></td><td>Ferrari</td><td>1:16.1</td><td>NC</td><td></td></tr>"
    short = "<tr><td>2</td><td>4</td></tr>"
    pages = spark.createDataFrame([(1, f"<table>{head}{row}{short}</table>"), (2, "<p>none</p>")], "page_id int, html string")
    out = x.extract_html_rows(pages).collect()
    assert [(i.page_id, i.position, i.driver, i.driver_code, i.team, i.time) for i in out] == [(1, 1, "CharlesLeclerc", "LEC", "Ferrari", "1:16.1")]


def test_weather_rules(spark):
    cls = lambda t, rain, s: value(spark, w.weather_impact_class(F.lit(t), F.lit(rain), F.lit(s)))
    assert cls(20.0, 61.0, 0.5) == "high_rain_impact" and cls(36.0, 31.0, 0.5) == "medium_rain_risk"
    assert cls(36.0, 0.0, 0.5) == "extreme_heat" and cls(31.0, 0.0, 0.7) == "high_heat_impact"
    assert cls(31.0, 0.0, 0.5) == "normal_conditions" and cls(10.0, 0.0, 0.5) == "cold_conditions"
    assert value(spark, w.strategy_notes(F.lit(31.0), F.lit(21.0))) == k.NOTES_DAMP + k.NOTES_HOT
    assert value(spark, w.strategy_notes(F.lit(20.0), F.lit(0.0))) == []


def test_guards_follow_their_pattern(spark):
    """A guard never loses a match, line breaks included."""
    texts = [
        "Ann Lee took pole\nwith a time of 1:15.372", "Ann Lee secured\npole position", "Ann Lee won\nthe race",
        "Ann received a\n5-second penalty", "Ann, the rain\nspecialist", "pole position: Ann\n1:15.372", "nothing",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for pattern in k.PATTERN_NEEDS:
        for flags in ("i", "is", "im"):
            bare = F.nullif(F.regexp_extract("text", f"(?{flags}){pattern}", 1), F.lit(""))
            both = docs.select(bare.alias("bare"), x.first_match(F.col("text"), [pattern], 1, flags).alias("guarded"))
            assert both.filter("NOT (bare <=> guarded)").isEmpty()


def test_standings_are_checked_before_any_cut(spark):
    bad = "\n".join(f"{i}. Ann Lee (LEE) - Ferrari - {i} points" for i in range(900, 920))
    good = "\n".join(f"{i}. Ann Lee (LEE) - Ferrari - {i} points" for i in range(1, 26))
    docs = spark.createDataFrame([(1, bad + "\n" + good)], "doc_id int, text string")
    assert x.driver_standings(docs, places=25).count() == 25
    assert x.driver_standings(docs, places=25, limit=20).count() == 20


def test_first_of_many_names_through_the_index(spark):
    rng = random.Random(6)
    letters = "abcd "
    names = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))).strip() for _ in range(300)} - {""})
    rng.shuffle(names)
    texts = [(i, "".join(rng.choice(letters + "XYZ") for _ in range(rng.randint(0, 80)))) for i in range(150)] + [(900, None), (901, ""), (902, "A" * 20_000)]
    known = spark.createDataFrame([(n.upper(), f"<{n}>", i) for i, n in enumerate(names)], "known string, full string, rank int")
    df = spark.createDataFrame([(*t, "old") for t in texts], "id int, text string, name string")
    got = {row.id: row.name for row in r.first_names(df, "id", "text", known).collect()}
    assert got == {i: next((f"<{n}>" for n in names if n in (t or "").lower()), None) for i, t in texts}
    assert r.first_names(df, "id", "text", known.limit(0)).filter("name IS NOT NULL").count() == 0
