"""Lists of sessions in weekend reports."""

import pytest
from pyspark.sql import functions as F

from lapforge.operators import extract as x
from lapforge.operators import reports

DOCS = "doc_id string, text string"
NAMES = ["Ann Abe", "Bea Bell", "Cid Cole", "Dan Dorn", "Eve East", "Fay Fox", "Gus Gray", "Hal Hill", "Ida Iron", "Jon Joy"]
POLE = "Ann Abe secured pole position with a time of 1:15.000."


def listed(lines):
    return "\n".join(lines)


def sessions(spark, text, **how):
    docs = spark.createDataFrame([("a", text)], DOCS)
    rows = reports.weekend_sessions(docs, **how).collect()
    return sorted((r.session, r.position, r.driver, r.time, r.estimated) for r in rows)


def test_a_list_of_ten_comes_out_whole(spark):
    lines = [f"{i}. {n} (Ferrari) – 1:15.{i:03d}" for i, n in enumerate(NAMES, 1)]
    text = f"Qualifying Results:\n{listed(lines)}\n\n1. Nobody Here - 1:10.000\n{POLE}"
    assert sessions(spark, text) == sorted(("Qualifying", i, n, f"1:15.{i:03d}", False) for i, n in enumerate(NAMES, 1))
    assert len(sessions(spark, text, limit=3)) == 3 and len(sessions(spark, text, places=4)) == 4


def test_rows_without_a_time_get_the_poles(spark):
    lines = ["1. Ann Abe (Ferrari) - 1:15.000", "2. Bea Bell (McLaren)", "3. Cid Cole", "4. Dan Dorn 1:15.900", "P5: Eve East - 1:16.000"]
    text = f"{POLE}\n\nStarting grid:\n{listed(lines)}\nThat was all"
    assert [r[1:] for r in sessions(spark, text)] == [
        (1, "Ann Abe", "1:15.000", False), (2, "Bea Bell", "1:15.100", True), (3, "Cid Cole", "1:15.200", True),
        (4, "Dan Dorn", "1:15.900", False), (5, "Eve East", "1:16.000", False),
    ]
    without = text.replace(POLE, "")
    assert [r[3] for r in sessions(spark, without)] == ["1:15.000", "", "", "1:15.900", "1:16.000"]


def test_sections_end_at_headings_blank_lines_and_other_words(spark):
    text = listed([
        "FP1 Results:", "1. Ann Abe - 1:16.000", "2. Bea Bell (McLaren)", "Free Practice 2 times:", "1. Cid Cole - 1:17.000",
        "Weather was fine", "2. Dan Dorn - 1:18.000", "", "Q3 results: 1. Eve East - 1:14.000", "2. Fay Fox - 1:14.500",
    ])
    assert [r[:4] for r in sessions(spark, text)] == [
        ("FP1", 1, "Ann Abe", "1:16.000"), ("FP1", 2, "Bea Bell", ""), ("FP2", 1, "Cid Cole", "1:17.000"),
        ("Qualifying", 1, "Eve East", "1:14.000"), ("Qualifying", 2, "Fay Fox", "1:14.500"),
    ]


def test_a_list_without_heading_is_taken_after_headed_ones(spark):
    bare = ["1. Ann Abe (Ferrari) - 1:15.100", "2. Bea Bell (Other) - 1:15.200", "3. Cid Cole"]
    assert [r[:3] for r in sessions(spark, "What a day\n" + listed(bare))] == [
        ("Qualifying", 1, "Ann Abe"), ("Qualifying", 2, "Bea Bell"), ("Qualifying", 3, "Cid Cole"),
    ]
    headed = listed(bare) + "\n\nGrid positions:\n1. Dan Dorn - 1:16.000"
    assert [r[2] for r in sessions(spark, headed)] == ["Dan Dorn"]
    assert sessions(spark, "1. Ann Abe (Other) - 1:15.100") == []


@pytest.mark.parametrize("line, session", [
    ("FP1: Ann Abe fastest (1:16.123)", "FP1"), ("Practice 3: Ann Abe tops with 1:16.123", "FP3"), ("Session FP2: Ann Abe 1:16.123", "FP2"),
])
def test_single_fastest_lines(spark, line, session):
    assert sessions(spark, f"Notes\n{line}\nmore") == [(session, 1, "Ann Abe", "1:16.123", False)]
    # A list of the session counts more than the line.
    both = f"{line}\n\n{session} Results:\n1. Bea Bell - 1:15.000"
    assert [r[2] for r in sessions(spark, both)] == ["Bea Bell"]


def test_the_grid_is_the_pole_alone_where_there_is_no_list(spark):
    assert sessions(spark, POLE) == [("Qualifying", 1, "Ann Abe", "1:15.000", False)]


def test_empty_null_long_and_repeated_texts(spark):
    rows = [("a", None), ("b", ""), ("c", "\n\n\n"), (None, POLE), (None, POLE), ("d", "Qualifying Results:\n" + "\n".join(f"{i}. Ann Abe - 1:15.000" for i in range(1, 5001)))]
    out = reports.weekend_sessions(spark.createDataFrame(rows, DOCS).withColumn("__text", F.lit(1)))
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {None: 2, "d": 5000}
    assert reports.weekend_sessions(spark.createDataFrame([], DOCS)).count() == 0


def test_short_pole_needs_one_line(spark, rows):
    docs = spark.createDataFrame([("a", "today Ann Abe took pole position in 1:15.1 and"), ("b", "pole position:\n1:15.2"), ("c", "1. Bea Bell 1:15.3"), ("d", "pole position for Cid Cole at 1:15.4")], DOCS)
    got = {r[0]: r[1:] for r in rows(x.short_pole(docs))}
    assert got["c"] == ("Bea Bell", "1:15.3") and "b" not in got and got["a"][1] == "1:15.1" and got["d"][1] == "1:15.4"
