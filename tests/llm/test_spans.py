"""Benchmark decontamination and personal data against brute force."""

import random
import re
import time

from pyspark.sql import functions as F

from lapforge.llm.decontam import contamination
from lapforge.llm.pii import KINDS, apart, learnt_patterns, masked, personal_spans, running, scanned, written
from lapforge.session import cut_lineage

DOCS = "doc_id long, text string"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([10, 11, 25, 40, 9, 5, 4, 1, 2, 10, 30])] + [(50, None), (51, "-- !")]
    items += [(60, items[2][1]), (2, items[2][1]), (61, "Ünder É9")]
    docs = [(0, None), (1, ""), (2, "."), (3, "w1"), (4, "ünder é9; W3")]
    for i in range(5, 80):
        parts = [text(rng.choice([0, 3, 12, 60]))]
        if i % 2:
            own = words_of(rng.choice(items)[1])
            a = rng.randrange(len(own) + 1)
            parts += [", ".join(own[a : a + rng.randint(1, 30)]), text(rng.choice([0, 5, 20]))]
        docs.append((i, " ".join(parts)))
    docs.append((90, text(3000)))
    docs.append((90, docs[-1][1]))

    def brute(doc):
        w, hit, found = words_of(doc), set(), set()
        for item, t in items:
            b = words_of(t)
            n = min(10, len(b))
            spans = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in spans:
                    hit.update(range(i, i + n))
                    found.add(item)
        return len(w), len(hit), sorted(map(str, found))

    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = contamination(df, benchmark).collect()
    assert len(got) == len(docs)
    assert all((r.n_words, r.n_hit, list(r.hit_items)) == brute(r.text) for r in got)
    assert contamination(df, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert contamination(df.limit(0), benchmark).count() == 0


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def base_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            odd = [int(c) for c in reversed(number)]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0
            good = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else False, 14 <= len(number) <= 19 and luhn, 10 <= len(number) <= 15)
            if good[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "a@b.c_d@e.f", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.255", "+1 (988) 555-2485", "+1234567890",
             "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111111", "1 1", "12 34-5", " ", "é", "😀", "@", ".", "-", "_",
             "foo", "5", "+", "(", ")", "\n", "a" * 30, "1" * 16, "4242424242424242", "00.00.00.00"]
    texts = [None, "", "9" * 20_000, "a" * 20_000 + "@", "a@" + "b." * 5000 + "c"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)
    for r in personal_spans(df).collect():
        assert [tuple(s) for s in r.base_spans] == base_spans(texts[r.doc_id])
        assert {tuple(s) for s in r.base_spans} <= {tuple(s) for s in r.spans}


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"hello, my number is +1 (9{i:02d}) 555-24{i:02d} ok") for i in range(30)]
    rows += [(100, "my number is 555-867-5309 thanks"), (101, "the score 555-867-5309 x"), (102, "mail a@b.cd")]
    found = personal_spans(spark.createDataFrame(rows, DOCS).withColumnRenamed("text", "text"))
    spans = {r.doc_id: r.s for r in found.select("doc_id", written(found["spans"]).alias("s")).collect()}
    assert (spans[100], spans[101], spans[102]) == ("phone:13:25", "", "email:5:11")
    shown = {r.doc_id: r.text for r in masked(found).collect()}
    assert shown[100] == "my number is [PHONE] thanks" and shown[102] == "mail [EMAIL]" and shown[101] == rows[31][1]
    assert personal_spans(spark.createDataFrame([], DOCS)).count() == 0
    assert KINDS == ("email", "ip", "card", "phone")


def test_several_kinds_are_learnt_over_more_than_one_round(spark):
    rows, seen = [], {}

    def say(text, kind=None, value=None):
        rows.append((len(rows), text))
        if kind:
            seen[len(rows) - 1] = (kind, value)

    for i in range(600):
        say(f"please ring +1 (9{i:03d}) 555-24{i % 90 + 10} today")
    for i in range(20):
        say(f"write to the box user{i}@mail{i}.org now")
        say(f"the host stands at 10.{i}.7.{i + 1} in the rack")
    # Unseen forms after contexts of seeds: found in the first round.
    for i in range(40):
        say(f"please ring ext#{i}77{i} today", "phone", f"ext#{i}77{i}")
        # The same values after a context that no seed has.
        say(f"front desk: ext#{i}77{i} or come by", "phone", f"ext#{i}77{i}")
    say("write to the box j0hn-at-host now", "email", "j0hn-at-host")
    say("the host stands at fe80::1:7 in the rack", "ip", "fe80::1:7")
    # Only the context that the first round's finds have proven speaks for these.
    for i in range(5):
        say(f"front desk: desk/{i}{i}5 or come by", "phone", f"desk/{i}{i}5")
    plain = len(rows)
    say("closed for 3000 years, says item zz-9000/1")
    say("ring the bell by 9am")
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    found = personal_spans(df)
    spans = {r.doc_id: [(KINDS[s.kind], r.text[s.start : s.stop]) for s in r.spans if s not in r.base_spans] for r in found.collect()}
    for d, one in seen.items():
        assert spans[d] == [one], rows[d]
    assert spans[plain] == spans[plain + 1] == [] and all(not spans[d] for d in range(640))
    # Without the first round's finds, the second's context has nothing sure.
    first = learnt_patterns(cut_lineage(scanned(df.filter("NOT contains(text, 'ring ext')"))))
    assert not [r for r in first.collect() if "desk:" in r.pattern]


def test_texts_full_of_matches_take_time_in_proportion(spark):
    mails = " ".join(f"user{i}@host{i}.org" for i in range(16_000))
    numbers = " ".join(f"id-{i}x" for i in range(16_000))
    both = " ".join(f"id-{i}x a{i}@b.cd" for i in range(8000))
    df = spark.createDataFrame([(0, mails), (1, numbers), (2, both)], DOCS)
    begin = time.monotonic()
    found = {r.doc_id: r for r in masked(personal_spans(df)).collect()}
    assert time.monotonic() - begin < 60
    assert len(found[0].base_spans) == 16_000 and found[0].text == " ".join(["[EMAIL]"] * 16_000)
    assert len(found[1].base_spans) == 0 and len(found[2].base_spans) == 8000
    assert [tuple(s) for s in found[2].base_spans] == base_spans(both)


def test_spans_keep_other_columns_and_their_names(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "x", 7), (None, None, None, None), (None, "", "y", 1)], "doc_id long, text string, spans string, __row int")
    rows = sorted(map(str, personal_spans(df, keep=["doc_id", "__row"]).collect()))
    assert len(rows) == 3 and personal_spans(df).columns[:2] == ["doc_id", "text"]


def test_running_values_and_apart(spark):
    rng = random.Random(8)
    for n in (0, 1, 63, 64, 65, 200):
        values = [rng.randint(0, 9) for _ in range(n)]
        starts = sorted(rng.sample(range(1000), n))
        spans = [(s, s + rng.randint(1, 4)) for s in starts]
        others = [(s, s + rng.randint(1, 6)) for s in sorted(rng.sample(range(1000), n // 3))]
        df = spark.createDataFrame([(values, spans, others)], "v array<int>, s array<struct<start:int,stop:int>>, o array<struct<start:int,stop:int>>")
        row = df.select(running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("sums"), apart(F.col("s"), F.col("o")).alias("free")).first()
        assert row.sums == [sum(values[:i]) for i in range(n)]
        assert [tuple(s) for s in row.free] == [s for s in spans if all(s[1] <= a or s[0] >= b for a, b in others)]
