import random
import re
from collections import defaultdict

import numpy as np

from lapforge.llm import jaccard_join
from lapforge.llm.jaccard_join import components, similarity_classes

SCHEMA = "doc_id long, text string, n_shingles string"


def brute(rows, size, percent):
    sets = {}
    for d, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        runs = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or ([tuple(words)] if words else [])
        sets[d] = frozenset(runs)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for e in holders[g]:
                shared[e] += 1
            holders[g].append(d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus():
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, "  \n "), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE two")]
    words = [f"w{i}" for i in range(30)]
    for i in range(7, 250):
        if i % 3 == 0:
            text = (rows[rng.randrange(3, i)][1]).split(" ")
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 10, 30, 100]))]
        rows.append((i, " ".join(text)))
    base = [f"z{i}" for i in range(120)]
    for i in range(250, 400):  # a large group of near copies, and their copies
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = f"q{rng.randrange(1000)}"
        rows.append((i, " ".join(text)))
    return [*rows, (400, "é" * 5000), (401, " ".join(words * 200))]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "other") for r in rows], SCHEMA).repartition(4)
    for size, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(df, size, percent).collect()}
        assert got == brute(rows, size, percent)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(7, "a b c d", "")] * 3 + [(9, "a b c d", "")]
    got = similarity_classes(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(7, 7)] * 3 + [(9, 7)]
    assert similarity_classes(spark.createDataFrame([], SCHEMA), 3, 90).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 105), (103, 105)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 103: 100, 105: 100}


def test_ranks_of_cells_are_made_in_tasks(spark):
    """The driver gets one byte for each cell of a stretch with frequent shingles, never the counts."""
    rng = np.random.default_rng(5)
    cells = rng.poisson(3, 1 << jaccard_join.CELL_BITS).astype(np.int64)
    cells[: 3 * jaccard_join.CHUNK] = 0
    cells[[17_000, 90_000, 4_000_000]] = 40, 5_000, 10**7
    chunks = cells.reshape(-1, jaccard_join.CHUNK)
    sent = [(i, bytearray(x.tobytes())) for i, x in enumerate(chunks) if x.any()]
    counts = spark.createDataFrame(sent, "chunk int, counts binary").repartition(3)
    usual = float(np.median(cells))
    assert jaccard_join.usual_count(counts) == usual
    order = jaccard_join.Order(counts, 100)
    above = np.maximum(cells - usual, 0)
    rank = np.where(above > jaccard_join.NOISE * order.noise, 1 + np.floor(np.log2(np.maximum(above, 1))), 0)
    assert order.rank.dtype == np.uint8 and (order.rank == rank).all()
    none = jaccard_join.Order(counts.limit(0), 0)
    assert jaccard_join.usual_count(counts.limit(0)) == 0 and not none.rank.any()
