import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lapforge.llm.bpe import Merges, WordIds
from lapforge.llm.bpe_codec import decode, encode
from lapforge.llm.token_counts import PrefixCounts, PrefixTokens, WordCounts, WordTables, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def texts():
    rng = random.Random(3)
    odd = [chr(c) for c in [*range(0x300), 0x3A3, 0x3C2, 0x130, 0x200B, 0x2028, 0x3000, 0x1F600, 0x301, 0x4E2D, 0xAC00]]
    out = [None, "", "a", "it's we'll I'D  x\n\n y ", "<|endoftext|>a<|endoftext|> b<|startoftext|>", "<|endoftext", "ΑΣ ΣΑΣ. İİ"]
    out += ["".join(rng.choice(odd if rng.random() < 0.5 else " ab'\n.") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [*out, "x" * 3000, "".join(rng.choice("ab ") for _ in range(40_000)), "a", "a"]


def test_merges_agree_with_naive_merging():
    merges = Merges(BYTES)
    rank = dict(zip(merges.keys.tolist(), merges.ranks.tolist(), strict=True))

    def naive(word):
        s = merges.symbols(word).tolist()
        while True:
            pairs = [(rank.get(a << 20 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(s, s[1:]))]
            if not pairs or min(pairs)[0] == 1 << 60:
                return s
            r, i = min(pairs)
            s[i : i + 2] = [int(merges.merged[r])]

    rng = random.Random(1)
    words = [bytes(rng.choice(b"the in aeiourst") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    words += [b"a" * 300, b"ab" * 400]
    ids, counts = merges.encode(words)
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [naive(w) for w in words]


def test_codec_equals_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    every = texts()
    df = spark.createDataFrame(list(enumerate(every)), SCHEMA).repartition(3)
    rows = {r.doc_id: r for r in encode(df, BYTES, decoded="decoded").collect()}
    again = {r.doc_id: r.decoded for r in decode(encode(df, BYTES), BYTES).collect()}
    for i, text in enumerate(every):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(rows[i].ids), "<u4").tolist() == ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].decoded == again[i] == library.decode(ids, skip_special_tokens=False)


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    every = texts()
    df = spark.createDataFrame(list(enumerate(every)), SCHEMA).repartition(3)
    for r in token_counts(df, WORDS, budgets=(5,), prefixes=True).collect():
        text = every[r.doc_id] or ""
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert r.n_bytes == len(text.encode())
        assert r.words_in_5 == sum(c <= 5 for c in r.prefix_tokens)


def test_every_prefix_is_exact():
    library, known = Tokenizer.from_file(WORDS), WordCounts(PrefixTokens(WORDS))
    for text in [t for t in texts()[1:60] if t] + ["international2024misunderstandings 'rest naïveté", "x" * 200]:
        counts = PrefixCounts(text, known)
        for end in range(len(counts.text) + 1):
            assert counts.at(end) == len(library.encode(counts.text[:end], add_special_tokens=False).ids)
        assert counts.at(counts.fit(4)) <= 4


def test_tables_are_filled_without_merging(monkeypatch):
    tokens = PrefixTokens(WORDS)
    tables = WordTables(tokens)
    monkeypatch.setattr(Merges, "encode", None)  # nothing is merged from here on
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30))).encode() for _ in range(300)]
    words += [b"aaaaaaa", b"hahahaha", b"mississippi", "naïveté".encode(), b"!!!!!!!!", b"z" * 100]
    library = Tokenizer.from_file(WORDS)
    counts, last, totals = tables.together(words)
    for word, count, end, total in zip(words, counts, last, totals, strict=True):
        known = library.encode(word.decode(), add_special_tokens=False).ids
        assert total == len(known)
        alone = tables.alone(word)
        inside = slice(0, len(word))
        assert alone[2] == total and (alone[0][inside] == count[inside]).all() and (alone[1][inside] == end[inside]).all()
        # What is before the last token is the encoding of that prefix.
        assert total == 1 or count[len(word) - len(library.id_to_token(known[-1]).removesuffix("</w>"))] == total - 1


def test_exactly_one_token_fits_at_a_place():
    tokens = PrefixTokens(WORDS)
    tables, word = WordTables(tokens), b"internationalization"
    _, last, _ = tables.alone(word)
    for end in range(1, len(word)):
        found = [(s, tokens.tokens[0].get(word[s:end])) for s in range(end)]
        fits = [s for s, t in found if t is not None and (s == 0 or tables._apart(int(last[s]), t))]
        assert len(fits) == 1


def test_forgetting_word_counts_changes_nothing():
    words = [f"w{i}ord{i * i}s" for i in range(60)] + ["the", "cat"]
    tokens = PrefixTokens(WORDS)
    small, large = WordCounts(tokens, most=7), WordCounts(tokens)
    assert [int(small.sizes([w])[0]) for w in words] == large.sizes(words).tolist()


@pytest.mark.parametrize("run", [lambda d: encode(d, BYTES), lambda d: token_counts(d, WORDS)])
def test_empty_tables_and_clashing_columns(spark, run):
    empty = spark.createDataFrame([], SCHEMA)
    assert run(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, n_tokens string")
    assert run(clash).select("n_tokens").dtypes == [("n_tokens", "bigint")]


def test_forgetting_words_changes_nothing():
    merges = Merges(BYTES)
    small, large = WordIds(merges, most=5), WordIds(merges)
    for words in (["the", " cat"], [" sat", ("<|endoftext|>",), "the"], [f" w{i}" for i in range(9)], ["the", " cat", "the"]):
        assert small.flat(small.lookup(words)).tolist() == large.flat(large.lookup(words)).tolist()
        assert small.sizes(words).tolist() == large.sizes(words).tolist()
    assert len(small.index) < len(large.index)
