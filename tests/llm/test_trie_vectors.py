"""The prefix trie, vector codes and top-k search against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.llm import prefix_trie, topk, vector_codes, vectors

TURNS = "conv_id long, turn long, role string, text string, depth string, q1 string"
VECTORS = "vec_id long, embedding array<double>, label int, code string, row string"


def how():
    conv = F.col("conv_id")
    return prefix_trie.Rebuild(base=conv - conv % 20, head=F.crc32(conv.cast("string").cast("binary")) % 4, most=3)


def said(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(v, key=lambda t: t[:3])] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        return [node, *(x for kid in kids[node] for x in below(kid))]

    out = []
    for node, who in members.items():
        subtree = below(node)
        saved = sum((len(members[n]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", n[-1][1])) for n in subtree if n)
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(not kids[n] for n in subtree)
        out.append((min(who), len(node), parent, len(who), len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    got = prefix_trie.prefix_trie(df, how()).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations():
    rng = random.Random(4)
    texts = ["hi", "hi there you", "", None, "a\tb  c", "no", "hi there you"]
    rows = []
    for c in [*range(0, 64), 200, 207, 1_000_003, -5, -40]:
        for turn in range(rng.randint(1, 5)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(19, None, "user", "null turn"), (21, 0, "user", "hi"), (21, 0, "user", "hi"), (21, 0, "", "user")]
    rows += [(None, 0, "user", "nobody"), (23, 2**40, "user", "late")]
    return rows


def test_trie_equals_brute_force(spark):
    rows = conversations()
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_nothing_and_of_one_long_conversation(spark, monkeypatch):
    assert trie(spark, []) == []
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    rows = [(40, i, "user", f"t{i % 3}") for i in range(60)] + [(41, i, "user", f"t{i % 3}") for i in range(45)]
    rows += [(60, 0, "user", "w " * 50_000)]
    assert trie(spark, rows) == brute_trie(rows)


def test_colliding_references_are_found_and_salted_away(spark, monkeypatch):
    rows = conversations()
    whole = prefix_trie._content

    def weak(role, text, salt):
        # Without a salt, only the text's length counts.
        return whole(role, text, salt) if salt else F.md5(F.length(F.coalesce(text, F.lit(""))).cast("string").cast("binary"))

    monkeypatch.setattr(prefix_trie, "_content", lambda role, text, salt: weak(F.col(role), F.col(text), salt))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    assert prefix_trie._ambiguous(df, 0) and not prefix_trie._ambiguous(df, 1)
    monkeypatch.undo()
    # Lanes that forget all but the length give nodes whose members disagree.
    rows = [(0, 0, "user", "a"), (20, 0, "user", "b")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    monkeypatch.setattr(prefix_trie, "_lane", lambda i: "1L")
    lanes = prefix_trie._positions(prefix_trie._turns(df, 0)).withColumnRenamed("k", "depth")
    assert prefix_trie._disagreeing(prefix_trie._nodes(lanes))


def random_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 8)], i % 3) for i in range(400)]
    rows += [(1000 + i, rows[5][1], None) for i in range(60)]  # copies
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 1), (None, rows[9][1], 2), (None, [0.5] * 8, None)]
    rows += [(2000, [0.0] * 8, 0), (2100, [0.25] * 5, 0), (2200, [], 0)]
    rows += [(3000, None, 0), (3001, [0.1] * 7 + [None], 0), (3002, [float("nan")] + [0.1] * 7, 1), (3003, [float("-inf")] * 8, 1)]
    return rows


def kept(rows):
    whole = [(i, [int(np.floor(1024 * x)) for x in v], lab) for i, v, lab in rows
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in whole), default=0)
    return [(i, v + [0] * (width - len(v)), lab) for i, v, lab in whole]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)


def brute_codes(rows, entries):
    rows = kept(rows)
    dim = len(rows[0][1]) // 4
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * dim : (p + 1) * dim] for r in ranked] for p in range(4)]

    def assign(v):
        out = []
        for p in range(4):
            part = v[p * dim : (p + 1) * dim]
            out.append(min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books[p])))
        return out

    for _ in range(4):
        sums = {}
        for _, v, _ in rows:
            for p, (_, e) in enumerate(assign(v)):
                total, n = sums.get((p, e), ([0] * dim, 0))
                sums[p, e] = ([a + b for a, b in zip(total, v[p * dim : (p + 1) * dim], strict=True)], n + 1)
        for (p, e), (total, n) in sums.items():
            books[p][e] = [t // n for t in total]
    flat = ",".join(str(x) for p in books for e in p for x in e)
    coded = [(i, lab, assign(v)) for i, v, lab in rows]
    by_label = defaultdict(int)
    for _, lab, a in coded:
        by_label[lab] += sum(d for d, _ in a)
    digest = hashlib.sha256(flat.encode()).hexdigest()
    out = [(i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), by_label[lab], digest) for i, lab, a in coded]
    return sorted(out, key=str)


@pytest.mark.parametrize("entries", [256, 9])
def test_codes_equal_brute_force(spark, entries):
    rows = random_vectors()
    got = vector_codes.product_codes(frame(spark, rows), entries=entries)
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == brute_codes(rows, entries)


def test_codes_of_no_vectors(spark):
    assert vector_codes.product_codes(frame(spark, [])).collect() == []
    assert vector_codes.product_codes(frame(spark, [(1, None, 1)])).collect() == []
    assert [r.code for r in vector_codes.product_codes(frame(spark, [(1, [], 1)])).collect()] == ["00000000"]


def test_equal_average_search_looks_at_equal_bounds_and_few_entries(monkeypatch):
    entries = np.array([[4, 0], [0, 4], [2, 2], [3, 3], [1, 1]])
    rows = np.array(list(product(range(6), repeat=2)))
    index, best = vector_codes.nearest(rows, entries)
    for row, i, d in zip(rows, index, best, strict=True):
        assert (d, i) == min((int(((row - e) ** 2).sum()), j) for j, e in enumerate(entries))
    # Entries on a line are ruled out by their sums: few of 4000 are compared.
    line = np.arange(4000)[:, None] * np.ones((1, 4), np.int64)
    looked = []
    plain = np.einsum
    monkeypatch.setattr(vector_codes.np, "einsum", lambda *a: looked.append(a[1].shape[1]) or plain(*a))
    assert vector_codes.nearest(line[1234:1235].astype(np.int64), line.astype(np.int64))[0].tolist() == [1234]
    assert sum(looked) < 100


def brute_top(rows, k):
    rows = kept(rows)
    out = []
    for a, (i, v, _) in enumerate(rows):
        if i is not None and i % 100 == 0:
            scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0) for b, (j, w, _) in enumerate(rows) if a != b]
            out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def top(spark, rows, k):
    got = topk.top_products(frame(spark, rows), F.col("vec_id") % 100 == 0, k)
    return sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("block", [4096, 97])
def test_top_products_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SHARE", 40)
    monkeypatch.setattr(topk, "CHUNK", 5)
    rows = random_vectors()
    assert top(spark, rows, 10) == brute_top(rows, 10)


def test_top_products_of_few_and_none(spark):
    assert top(spark, [], 10) == []
    assert top(spark, [(1, [1.0], 1)], 10) == []
    assert top(spark, [(100, [1.0], 1)], 10) == []
    rows = [(100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (None, [3.0], 1)]
    assert top(spark, rows, 10) == brute_top(rows, 10)


def test_reading_stops_before_the_lists_end_and_loses_nobody():
    rng = np.random.default_rng(5)
    values = rng.integers(-300, 300, (4000, 6))
    lists = topk.SortedLists(values)
    for query in rng.integers(-300, 300, (20, 6)):
        score = values @ query
        tenth = int(np.sort(score)[-10])
        places = lists.qualifying(query, int(np.sort(score)[-12]), 10)
        assert set(np.flatnonzero(score >= tenth)) <= set(places.tolist())
        assert len(places) <= 10 + 4000 // topk.SHARE and lists.needed < lists.steps


def test_whole_numbers_that_leave_a_long_are_an_error(spark):
    with pytest.raises(OverflowError):
        vectors.fits(1 << 31, 3)
    vectors.fits(1 << 30, 4)
