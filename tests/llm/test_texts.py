"""Fingerprints, chat formatting, main text, quality, toxicity and the pipeline."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lapforge.llm import chat, fingerprints, html_blocks, quality, toxicity, words

DOCS = "doc_id long, text string"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_next_rows_wrap_around_and_cross_blocks(spark):
    ids = [5, 511, 512, 513, 2000, -3, 90_000, None]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], DOCS).repartition(3)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, "doc_id", ["text"]).collect()}
    order = [90_000, 2000, 513, 512, 511, 5, -3, None]
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_fingerprints_follow_the_terms(spark):
    rng = random.Random(1)
    words = [f"term{i}" for i in range(400)]
    rows = [(i, sentence(rng, 80, words)) for i in range(60)]
    rows += [(100, rows[0][1]), (101, " ".join(reversed(rows[0][1].split()))), (102, None), (103, ""), (104, "…")]
    near = rows[1][1].split()
    near[-4:] = ["other", "words", "at", "end"]
    rows.append((105, " ".join(near)))
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", marks string")
    marked = fingerprints.fingerprinted(df, df)
    got = {r.doc_id: r.print for r in marked.select("doc_id", fingerprints.written("marks").alias("print")).collect()}
    assert got[0] == got[100] == got[101] and got[102] == got[103] == got[104] != got[0]
    pairs = marked.alias("a").join(marked.alias("b"), F.col("a.doc_id") < F.col("b.doc_id"))
    close = {(r.x, r.y): r.near for r in pairs.select(
        F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), fingerprints.likeness("a.marks", "b.marks").alias("near")).collect()}
    assert close[0, 100] == 1.0 and close[1, 105] > 0.5 > close[0, 1] and close[102, 103] == 1.0
    assert fingerprints.fingerprinted(df.limit(0), df.limit(0)).count() == 0


def test_the_band_holds_for_terms_whose_hashes_end_alike(spark):
    words = spark.range(3000).select(F.concat(F.lit("w"), F.col("id")).alias("w"))
    ends = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit((1 << 18) - 1))).agg(F.sort_array(F.collect_list("w")).alias("w"))
    usual, rare = ends.filter(F.size("w") > 1).orderBy("w").first().w[:2]
    # The two share the last 18 bits; one is in a tenth of the documents, the other in one of them.
    rows = [(i, f"{usual} t{i}" if i % 10 == 0 else f"t{i}") for i in range(998)] + [(998, usual), (999, f"{usual} {rare}")]
    df = spark.createDataFrame(rows, DOCS)
    band = {t for bucket in fingerprints.lexicon(df).first().lexicon for t in bucket}
    assert band == {spark.sql(f"SELECT xxhash64('{usual}')").first()[0]}
    got = {r.doc_id: r.marks for r in fingerprints.fingerprinted(df, df).filter("doc_id >= 998").collect()}
    assert got[998] == got[999]


def test_chat_layouts(spark):
    records = [
        '{"prompt":"hi","response":"yo"}', '{"system":"s","prompt":"hi","response":"yo","extra":{"a":[1]}}',
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}],"zzz":1}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}',
        '{"instruction":"i","input":"n","output":"o"}', '{"question":"q","answer":"a"}', '{"foo":1}', None, "no json",
    ]
    df = spark.createDataFrame([(i, r, "old") for i, r in enumerate(records)], "i int, record string, layout string")
    got = {r.i: (r.layout, [tuple(t) for t in r.turns or []]) for r in chat.canonical_turns(df, "record").collect()}
    assert got[0] == ("prompt", [("user", "hi"), ("assistant", "yo")])
    assert got[1] == ("prompt", [("system", "s"), ("user", "hi"), ("assistant", "yo")])
    assert got[2] == ("messages", [("user", "a"), ("assistant", "")])
    assert got[3] == ("conversations", [("user", "q"), ("assistant", "r")])
    assert got[4] == ("instruction", [("user", "i\n\nn"), ("assistant", "o")])
    assert got[5] == ("question", [("user", "q"), ("assistant", "a")])
    assert [got[i] for i in (6, 7, 8)] == [(None, [])] * 3


def test_chat_texts_of_any_length(spark):
    long = 20_000_001
    said = spark.range(1).select(F.repeat(F.col("id").cast("string"), long).alias("said"))
    structs = said.select(F.struct(F.lit("user").alias("role"), F.col("said").alias("text")).alias("record"))
    lists = said.select(F.struct(F.array(F.struct(F.col("said").alias("content"), F.lit("user").alias("role"))).alias("messages")).alias("record"))
    for df, layout in ((structs, "turn"), (lists, "messages")):
        for records in (df, df.select(F.to_json("record").alias("record"))):
            got = chat.canonical_turns(records, "record").select("layout", F.explode("turns").alias("t")).select("layout", "t.role", F.length("t.text"))
            assert [tuple(r) for r in got.collect()] == [(layout, "user", long)]


def test_chat_structs_of_other_types(spark):
    df = spark.sql(
        "SELECT named_struct('prompt', 5, 'response', named_struct('a', 1), 'system', CAST(NULL AS STRING), 'zzz', 1) AS a,"
        " named_struct('conversations', array(named_struct('value', 1.5D, 'from', 'gpt'), NULL)) AS b, CAST(NULL AS STRUCT<text: STRING>) AS c,"
        " named_struct('messages', 'x', 'text', DATE'2024-01-02') AS d, named_struct('zzz', 1) AS e"
    )
    got = {c: chat.canonical_turns(df, c).first() for c in df.columns}
    read = {c: (r.layout, [tuple(t) for t in r.turns]) for c, r in got.items()}
    assert read == {
        "a": ("prompt", [("user", "5"), ("assistant", '{"a":1}')]), "b": ("conversations", [("assistant", "1.5"), ("", "")]),
        "c": ("blank turn", [("", "")]), "d": ("text", [("", "2024-01-02")]), "e": ("blank turn", [("", "")]),
    }


def test_chat_format_reads_back(spark):
    rng = random.Random(8)
    parts = ["<|turn|>", "<|end|>\n", "<", "\\", "|", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "<\\|", "é😀", "\n", "x", "[\\/INST]"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))))
            for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(50, 0, None, None), (51, None, "<|text|>", "a"), (51, 0, "assistant", None), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.formatted(df)
    for r in out.collect():
        assert r.piece.count("<|turn|>") == r.piece.count("<|end|>") == r.piece.count("<|text|>") == 1
        assert "[INST]" not in r.piece and "</s>" not in r.piece
    for r in chat.digests(out).collect():
        own = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        said = "".join(x[3] for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_main_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies for everything that we do here on this site</div><article><h1>A &amp; B</h1>"
        "<p>Some  <b>bold</b>\ntext &lt;here&gt;<!-- <p>no</p> --><br>next<p>Be.<ul><li>one</li><li><a href='x>y'>two</a></li></ul>"
        "<aside>Related</aside><script>var t='</p>';</script></article><div id=comments><p>" + "nice " * 30 + "</p></div>"
        "<footer>&copy; x</footer></body></html>"
    )
    want = "A & B\nSome bold text <here> next\nBe.\none\ntwo"
    long = "<article>" + "<p>ab cd</p>" * 5000
    pages = [(0, page, 1), (1, None, 1), (2, "", 1), (3, "<p", 1), (4, "<!-- open", 1), (5, long, 1), (5, long, 1), (6, "<" * 3000, 1)]
    df = spark.createDataFrame(pages, "page_id long, html string, text int")
    got = [(r.page_id, r.text, r.n_chars) for r in html_blocks.extracted(df).collect()]
    texts = {p: t for p, t, _ in got}
    assert len(got) == len(pages) and all(n == len(t) for _, t, n in got)
    assert texts[0] == want and texts[5] == "\n".join(["ab cd"] * 5000)
    assert texts[1] == texts[2] == texts[3] == texts[4] == ""
    assert html_blocks.extracted(df.limit(0)).count() == 0


ARTICLE = "<body><nav><a href=/x>Home</a></nav><article><h1>Head</h1><p>{0}</p>{1}<p>{0}</p></article><footer>x</footer></body>"
PLAIN = "some words of the article go on here " * 4


@pytest.mark.parametrize("word", sorted(html_blocks.STRONG | html_blocks.WEAK | {"side-by-side", "search-tips", "legal"}))
def test_no_class_word_drops_text_of_an_article(word):
    tree = html_blocks.trained()
    for tag in ("p", "h2", "blockquote"):
        page = ARTICLE.format(PLAIN, f"<{tag} class='{word}'>kept {PLAIN}</{tag}>")
        assert html_blocks.main_text(page, tree).count("kept") == 1
    mixed = ARTICLE.format(PLAIN, f"<div class='{word}-of-the-main-story'>kept {PLAIN}</div>")
    assert html_blocks.main_text(mixed, tree).count("kept") == 1


def test_a_header_is_a_menu_outside_an_article_only():
    tree = html_blocks.trained()
    page = ARTICLE.format(PLAIN, "<header><h2>Inner head</h2></header>").replace("<body>", "<body><header><h1>The site</h1></header>")
    assert "Inner head" in html_blocks.main_text(page, tree) and "The site" not in html_blocks.main_text(page, tree)
    for tag in ("aside", "form", "nav", "footer"):
        assert "away" not in html_blocks.main_text(ARTICLE.format(PLAIN, f"<{tag}><p>away {PLAIN}</p></{tag}>"), tree)
    for name in ("cookie-notice", "newsletter-signup", "ad", "comments"):
        assert "away" not in html_blocks.main_text(ARTICLE.format(PLAIN, f"<div class='{name}'><p>away {PLAIN}</p></div>"), tree)


def test_link_density_and_words_decide_inside_and_outside_articles():
    tree = html_blocks.trained()
    plain, linked = "<li>{} item of a list</li>", "<li><a href=/x>{} item of a list</a></li>"
    numbers = ["one", "two", "three", "four", "five"]

    def kept(rows):
        text = html_blocks.main_text(ARTICLE.format(PLAIN, "<ul>" + "".join(rows) + "</ul>"), tree)
        return [n for n in numbers if f"{n} item" in text]

    assert kept([plain.format(n) for n in numbers]) == numbers
    assert kept([linked.format(n) if n == "three" else plain.format(n) for n in numbers]) == numbers
    # The same block between links, once as a link and once not.
    assert kept([linked.format(n) for n in numbers]) == ["one", "five"]
    assert kept([plain.format(n) if n == "three" else linked.format(n) for n in numbers]) == ["one", "two", "three", "four", "five"]
    bare = "<body><div>{}</div><div>{}</div><div>{}</div></body>"
    long = PLAIN * 3
    assert html_blocks.main_text(bare.format(long, long, long), tree).count("\n") == 2
    assert html_blocks.main_text(bare.format("Home", "News", "About us"), tree) == ""
    assert html_blocks.main_text(bare.format(long, f"<a href=/x>{PLAIN}</a>", long), tree).count("\n") == 1


@pytest.mark.parametrize("page, blocks", [
    ("<p>a</b>" * 40_000, 40_000), ("<section>" * 60_000 + "x", 1), ("<ul>" + "<li>a b" * 60_000, 60_000),
    ("<table>" + "<tr><td>a<td>b" * 25_000, 50_000), ("<h1>x" * 60_000, 60_000), ("<div><p>x</i>" * 40_000, 40_000), ("<a href=x>w " * 60_000, 1),
    ("</p>" * 200_000 + "x", 1), ("<b>" * 200_000 + "x", 1),
])
def test_broken_pages_of_any_length_take_time_in_proportion(page, blocks):
    begin = time.process_time()
    assert len(html_blocks.blocks(page)) == blocks
    assert time.process_time() - begin < 15


def labelled(spark, n=240):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("lor", "ip", "sum", "dol", "amet") for b in ("a", "en", "ing", "is", "orum")]
    rows, labels = [], []
    for i in range(n):
        text, bad, toxic = sentence(rng, rng.randint(20, 120), words) + ".", i % 4 == 0, i % 5 == 0
        if bad:
            text = " ".join(w + rng.choice(["%%%", "$$$", "***"]) for w in text.split())
        elif toxic:
            parts = text.split()
            for _ in range(rng.randint(2, 6)):
                parts.insert(rng.randrange(len(parts)), rng.choice(["vile", "nasty"]))
            text = " ".join(parts)
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic and not bad)))
    rows += [(n, None), (n + 1, ""), (n + 2, "word " * 20_000), (0, rows[0][1])]
    labels += [(n + 9, 1, 1), (None, 0, 1), (5, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    held = F.col("doc_id") % 3 == 0
    scores = quality.scored(docs, labels, F.col("quality"), ~held)
    marks = {r.doc_id: r.quality for r in labels.filter("doc_id < 240 and quality is not null").collect()}
    rows = scores.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held_out = [(r.score >= 0.3) == (marks[r.doc_id] == 1) for r in rows if r.doc_id in marks and r.doc_id % 3 == 0]
    assert np.mean(held_out) > 0.95
    plain = quality.scored(docs, labels.limit(0), F.col("quality"), F.lit(True))
    assert {r.score for r in plain.collect()} == {0.5}
    assert quality.scored(docs.limit(0), labels, F.col("quality"), F.lit(True)).count() == 0


def test_scores_equal_a_dense_computation(spark):
    docs, labels = labelled(spark)
    stats = {r.doc_id: np.array(r.statistics) for r in quality.with_statistics(docs).collect()}
    marks = {r.doc_id: r.quality for r in labels.filter("doc_id < 240 and quality is not null").collect()}
    learnt = [d for d in marks if d % 3]
    # Document 0 is there twice and is not learnt from; every other one counts once.
    own = {k: np.array([stats[d] for d in learnt if marks[d] == k]) for k in (0, 1)}
    spread = {k: np.cov(x.T, bias=True) for k, x in own.items()}
    pooled = sum(len(own[k]) * np.diag(spread[k]) for k in (0, 1)) / len(learnt) + 1e-6

    def density(x, k):
        covariance = 0.9 * spread[k] + 0.1 * np.diag(pooled)
        gap = x - own[k].mean(0)
        return -0.5 * (gap @ np.linalg.solve(covariance, gap) + np.linalg.slogdet(covariance)[1]) + np.log(len(own[k]) / len(learnt))

    scores = quality.scored(docs, labels, F.col("quality"), F.col("doc_id") % 3 != 0)
    for r in scores.collect():
        want = 1 / (1 + np.exp(np.clip(density(stats[r.doc_id], 0) - density(stats[r.doc_id], 1), -500, 500)))
        assert abs(r.score - want) < 1e-6


def test_statistics_of_pieces_are_those_of_the_whole(monkeypatch):
    rng = random.Random(2)
    texts_ = ["", None, "é" * 50, "A! b|c\n", "x" * 500, " " * 300, *("".join(rng.choice("aB 1.!|%\né") for _ in range(400)) for _ in range(20))]
    whole = quality.statistics(pa.array(texts_))
    hashes = words.word_hashes(*words.text_bytes(pa.array(texts_)), words.SPACED)
    monkeypatch.setattr(words, "PIECE_BYTES", 37)
    monkeypatch.setattr(quality, "PIECE_BYTES", 37)
    assert np.array_equal(whole, quality.statistics(pa.array(texts_)))
    again = words.word_hashes(*words.text_bytes(pa.array(texts_)), words.SPACED)
    assert all(np.array_equal(a, b) for a, b in zip(hashes, again, strict=True))
    for text, row in zip(texts_, whole, strict=True):
        text = text or ""
        split = text.split()
        assert np.isclose(row[0], np.log1p(len(text))) and np.isclose(row[4], np.sqrt(text.count("!") / max(len(text), 1)))
        assert np.isclose(row[11], len(set(split)) / max(len(split), 1))


def test_fingerprints_equal_a_plain_computation(spark):
    rng = random.Random(3)
    usual = [f"term{i}" for i in range(120)]
    rows = [(i, sentence(rng, 40, usual) + f" rare{i}" + (" every" if i % 50 else "")) for i in range(150)] + [(200, None), (201, "…"), (202, "word " * 30_000)]
    df = spark.createDataFrame(rows, DOCS)
    mask = (1 << 64) - 1
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    terms = {d: sorted({signed(xxhash.xxh64(w.encode(), 42).intdigest()) for w in re.split(r"[\W_]+", (t or "").lower()) if w}) for d, t in rows}
    held = Counter(h for own in terms.values() for h in own)
    inside = {h for h, n in held.items() if 1.5 <= np.log(len(rows) / n) <= 6.5}
    # All terms of a corpus this small that are not rare or everywhere.
    assert inside and len(inside) < len(held)

    def digest(hashes):
        h = 42
        for x in hashes:
            h = xxhash.xxh64((x & mask).to_bytes(8, "little"), h).intdigest()
        return h & 0xFFFFFFFF

    def marks(own):
        kept = [h for h in own if h in inside] or own
        out = [digest(kept)]
        for d in range(fingerprints.DRAWS):
            for level in fingerprints.LEVELS:
                out.append(digest([h for h in kept if not (h & mask) >> (16 + 4 * d) & ((1 << level) - 1)]))
        return out

    got = {r.doc_id: r for r in fingerprints.fingerprinted(df, df).withColumn("print", fingerprints.written("marks")).collect()}
    for d, own in terms.items():
        want = marks(own)
        assert [m & 0xFFFFFFFF for m in got[d].marks] == want and got[d].print == "".join(f"{m:08x}" for m in want)
    a, b = marks(terms[1]), marks(terms[2])
    votes = []
    for d in range(fingerprints.DRAWS):
        places = range(1 + 5 * d, 6 + 5 * d)
        known = [p for p in places if a[p] != fingerprints.EMPTY or b[p] != fingerprints.EMPTY]
        votes += [a[known[-1]] == b[known[-1]]] if known else []
    pair = spark.createDataFrame([(got[1].marks, got[2].marks)], "a array<int>, b array<int>")
    assert abs(pair.select(fingerprints.likeness("a", "b")).first()[0] - np.mean(votes)) < 1e-9


def test_next_rows_of_sparse_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 4)
    rng = random.Random(4)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(60)]
    rows = [(i, f"t{i}") for i in ids] + [(None, f"n{k}") for k in range(30)] + [(7, "same"), (7, "same"), (7, "other")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = fingerprints.with_next(df, "doc_id", ["text"]).collect()
    follow = Counter((r.text, r.next_text) for r in got)
    assert Counter(r.next_text for r in got) == Counter(t for _, t in rows)
    order = [f"t{i}" for i in sorted(ids, reverse=True)]
    numbered = [(a, b) for a, b in zip(order, order[1:]) if not ids or not (int(b[1:]) < 7 < int(a[1:]))]
    assert all(follow[p] == 1 for p in numbered)
    assert fingerprints.with_next(df.limit(0), "doc_id", ["text"]).count() == 0


def test_toxicity_on_held_out_rows_and_many_words(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    severity = {r.doc_id: r.severity for r in toxicity.scored(docs, model, keep=["doc_id"]).collect()}
    marks = {r.doc_id: r.toxic for r in labels.filter("doc_id < 240 and doc_id % 2 = 1 and toxic is not null").collect()}
    assert np.mean([(severity[d] >= toxicity.REJECT) == bool(t) for d, t in marks.items()]) > 0.97
    # Every word that passes the thresholds is a feature, however many there are.
    rng = random.Random(7)
    bad = [f"bad{i}" for i in range(6000)]
    rows = [(i, " ".join(rng.sample(bad, len(bad)))) for i in range(12)] + [(100 + i, sentence(rng, 30, ["fine", "good", "nice"])) for i in range(30)]
    marks = spark.createDataFrame([(d, int(d < 100)) for d, _ in rows], "doc_id long, toxic int")
    many = toxicity.fit(spark.createDataFrame(rows, DOCS), marks)
    assert len(many.vocabulary) == 6000
    assert toxicity.scored(docs.limit(0), model).count() == 0 and len(toxicity.fit(docs.limit(0), labels).vocabulary) == 0


def test_one_text_for_each_labelled_id(spark):
    rows = [(1, f"vile w{i}") for i in range(500)] + [(2, "fine words")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    # Five hundred texts of one id are one sample row: too few for any feature.
    assert len(toxicity.fit(spark.createDataFrame(rows, DOCS), labels).vocabulary) == 0


def test_clashing_columns_are_replaced_or_carried(spark):
    docs, labels = labelled(spark, 60)
    odd = docs.withColumns({"severity": F.lit("x"), "statistics": F.lit("y"), "label": F.lit(1), "words": F.lit(2)})
    assert dict(toxicity.scored(odd, toxicity.fit(odd, labels)).dtypes)["severity"] == "double"
    held = quality.scored(odd, labels.withColumn("statistics", F.lit(0)), F.col("quality"), F.lit(True))
    assert held.columns == ["doc_id", "score"] and held.count() == docs.count()


def test_toxicity_finds_toxic_rows_only(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    severity = {r.doc_id: r.severity for r in toxicity.scored(docs, model).collect()}
    marks = {r.doc_id: r.toxic for r in labels.filter("doc_id < 240 and toxic is not null").collect()}
    wrong = [d for d, t in marks.items() if (severity[d] >= toxicity.REJECT) != bool(t)]
    assert len(wrong) <= 2
    assert severity[240] == severity[241] < toxicity.REJECT
    nothing = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.severity for r in toxicity.scored(docs, nothing).collect()} == {0.0}


def test_pipeline_decisions(spark, tmp_path):
    docs, labels = labelled(spark)
    rng = random.Random(9)
    other = [f"b{i}" for i in range(60)]
    item = sentence(rng, 30, other)
    copy = sentence(rng, 100, other)
    more = [(500, "start " + item + " end"), (501, copy), (502, copy + " tail"), (503, "write to me@my.org now please")]
    docs = docs.filter("doc_id < 240").dropDuplicates(["doc_id"]).union(spark.createDataFrame(more, DOCS))
    full = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    full.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "personal_data", "bpe"]
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == full.columns
    kept = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 500 not in kept and 502 not in kept and kept[501] == copy
    assert kept[503] == "write to [EMAIL] now please"
    toxic = {r.doc_id for r in labels.filter("toxic = 1 and doc_id < 240").collect()}
    clean = {r.doc_id for r in labels.filter("toxic = 0 and doc_id < 240").collect()} - {5}
    assert len(toxic & set(kept)) <= 2 and len(clean - set(kept)) <= 2


def test_pipeline_decides_for_rows(spark, tmp_path):
    """Repeated and missing ids, null and empty texts, and columns named like an operator's own."""
    rng = random.Random(11)
    words_ = [f"w{i}" for i in range(50)]
    item, near, other = sentence(rng, 30, words_), sentence(rng, 80, words_), sentence(rng, 60, words_)
    rows = [
        (None, "a " + item), (None, near), (7, near + " end"), (3, near), (3, near), (3, other), (9, "b " + item + " c"), (9, sentence(rng, 40, words_)),
        (None, other + " x"), (None, None), (None, ""), (12, None), (13, "mail me@my.org"),
    ]
    names = ["spans", "component_id", "n_hit", "severity", "statistics", "n_tokens", "__row"]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), *names) for r in rows],
                                 DOCS + ", lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/step{i}")
        step = spark.read.parquet(f"{tmp_path}/step{i}")
        assert step.columns == docs.columns
        assert step.select(names).distinct().collect() == [tuple(names)]
    got = Counter((r.doc_id, r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter([(3, near), (3, other), (9, rows[7][1]), (None, ""), (None, ""), (12, ""), (13, "mail [EMAIL]")])


def test_pipeline_of_nothing(spark, tmp_path):
    for name, schema in (("documents", DOCS + ", lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
