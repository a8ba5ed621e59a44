"""Exact token counts of every prefix by dynamic programming.

The encoding of a prefix of a word ends in one token, and what is before that token is the
encoding of a shorter prefix. So a table over the places of a word, with the count and the last
token of each prefix, is filled from left to right: the last token of a prefix is the token of the
vocabulary that ends there and is compatible with the last token of the prefix before it: of all
tokens that end there exactly one is. Two tokens are compatible if no merge would join them while
their own bytes become the two. No text is merged: counts of whole words, of words cut anywhere,
truncation and budgets are all read from the tables.

The vocabulary marks the last byte of a word, so a place has two readings: a prefix inside the
word, from which the table goes on, and the word cut there, whose last token carries the mark.
Over words, the counts add up to one running sum, the exact count of every prefix of the text.

Many words are taken together, place by place; long words have a table each.

Defined results: a null text is empty (0 tokens); special strings inside a text count one
each; repeated rows stay; an empty table gives an empty table; other columns are carried
along, except ones named like a result, which are replaced.
"""

from __future__ import annotations

import copy
import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lapforge.llm.arrow import texts, with_columns
from lapforge.llm.bpe import NONE, Merges, byte_letters, special_splitter
from lapforge.llm.words import text_bytes

# The vocabulary's pattern for words: a fixed value. Everything else (white space) is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
_WORDS = regex.compile(PATTERN)
_SPACES = regex.compile(r"\p{White_Space}+")


def normalized(text: str) -> str:
    """NFC, runs of white space as one space, every character lower-cased on its own."""
    text = _SPACES.sub(" ", unicodedata.normalize("NFC", text))
    return text.replace("Σ", "σ").lower()  # a final capital sigma is no special case


class PrefixTokens:
    """Tokens of a vocabulary as a trie over bytes, and which pairs of them are compatible.

    A token that its own bytes do not merge to is never the last of a prefix and is left out.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        closed = Merges(path)
        # The same merges for bytes of which none is a word's last.
        inner = copy.copy(closed)
        inner.last = inner.first
        self.merges, self.specials = closed, closed.specials
        back = {c: b for b, c in enumerate(byte_letters())}
        self.tokens: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})  # inside a word, at its end
        for token, at in model["vocab"].items():
            end = bool(suffix) and token.endswith(suffix)
            letters = token[: len(token) - len(suffix)] if end else token
            if letters and all(c in back for c in letters):
                spelled = bytes(back[c] for c in letters)
                for kind in (0, 1) if not suffix else (int(end),):
                    self.tokens[kind][spelled] = at
        for known, merges in zip(self.tokens, (inner, closed), strict=True):
            ids, counts = merges.encode(list(known))
            first = ids[np.cumsum(counts) - counts]
            kept = {spelled: at for i, (spelled, at) in enumerate(known.items()) if counts[i] == 1 and first[i] == at}
            known.clear()
            known.update(kept)
        self.longest = max(map(len, [*self.tokens[0], *self.tokens[1]]))
        self._trie()
        self._edges()

    def _trie(self) -> None:
        """Edges as sorted keys (node * 256 + byte), and the tokens that end at a node."""
        nodes: dict[bytes, int] = {b"": 0}
        edges: dict[int, int] = {}
        for spelled in [*self.tokens[0], *self.tokens[1]]:
            for end in range(1, len(spelled) + 1):
                if spelled[:end] not in nodes:
                    nodes[spelled[:end]] = len(nodes)
                    edges[nodes[spelled[: end - 1]] * 256 + spelled[end - 1]] = nodes[spelled[:end]]
        keys = np.array(sorted(edges), np.int64)
        self.edge_keys, self.edge_to = keys, np.array([edges[k] for k in keys.tolist()], np.int64)
        self.ends = np.full((2, len(nodes)), -1, np.int64)
        for kind in (0, 1):
            for spelled, at in self.tokens[kind].items():
                self.ends[kind, nodes[spelled]] = at

    def _edges(self) -> None:
        """For each token the symbols at its right and at its left edge as its bytes are merged, each
        with the rank of the merge that takes it up; NONE for the token itself."""
        merges = self.merges
        order = np.argsort(merges.ranks)
        left, right = merges.keys[order] >> 20, merges.keys[order] & 0xFFFFF
        made: dict[int, int] = {}  # by the merge of least rank
        for rank, token in enumerate(merges.merged.tolist()):
            made.setdefault(token, rank)
        size = int(max(*self.tokens[0].values(), *self.tokens[1].values())) + 1
        self.edges = []
        for half in (right, left):
            lists: dict[int, list[tuple[int, int]]] = {}

            def edge(token: int, half=half, lists=lists) -> list[tuple[int, int]]:
                if token not in lists:
                    rank = made.get(token)
                    if rank is None:
                        lists[token] = [(token, int(NONE))]
                    else:
                        inner = edge(int(half[rank]))
                        lists[token] = [*inner[:-1], (inner[-1][0], rank), (token, int(NONE))]
                return lists[token]

            every = {t: edge(t) for known in self.tokens for t in known.values()}
            deep = max(map(len, every.values()))
            symbols, ranks = np.zeros((size, deep), np.int64), np.full((size, deep), NONE, np.int64)
            for token, listed in every.items():
                for i, (symbol, rank) in enumerate(listed):
                    symbols[token, i], ranks[token, i] = symbol, rank
            self.edges.append((symbols, ranks))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two tokens stay apart.

        The merges of both go by rank, and so does the pair of symbols on either side of the border,
        if it is a merge: it comes first unless the left symbol is taken up no later, or the right
        one before. After each step the next pair on the border is looked at.
        """
        (right_edge, taken), (left_edge, gone) = self.edges
        apart = np.ones(len(left), bool)
        who, a, b = np.arange(len(left)), left, right
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        while len(who):
            across = self.merges.rank(right_edge[a, i], left_edge[b, j])
            own, other = taken[a, i], gone[b, j]
            joined = (across < own) & (across <= other)
            apart[who[joined]] = False
            on = ~joined & ((own < NONE) | (other < NONE))
            first = own <= other
            i, j = (i + first)[on], (j + ~first)[on]
            who, a, b = who[on], a[on], b[on]
        return apart


PIECE = 1 << 21  # bytes of text taken together
LONG = 128  # bytes from which a word has a table of its own
TOGETHER = 1 << 18  # places of words taken together


class WordTables:
    """Tables over the prefixes of words: `counts[i]` tokens and the last of them for i bytes inside
    the word (place 0 is empty)."""

    def __init__(self, tokens: PrefixTokens):
        self.tokens = tokens

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, last tokens, tokens of the whole word) of words, a row each; place after place."""
        n, sizes = len(words), np.array([len(w) for w in words], np.int64)
        width = int(sizes.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        row, start, end, token = self._found(raw, sizes)
        counts, last, totals = np.zeros((n, width + 1), np.int64), np.full((n, width + 1), -1, np.int64), np.zeros(n, np.int64)
        order = np.argsort(start, kind="stable")
        row, start, end, token = row[order], start[order], end[order], token[order]
        bounds = np.searchsorted(start, np.arange(width + 1))
        for place in range(width):
            some = slice(bounds[place], bounds[place + 1])
            r, e, t = row[some], end[some], token[some]
            if place:
                before = last[r, place]
                fits = self.tokens.compatible(before, t)
                r, e, t = r[fits], e[fits], t[fits]
            count = counts[r, place] + 1
            whole = e == sizes[r]
            totals[r[whole]] = count[whole]
            r, e, t, count = r[~whole], e[~whole], t[~whole], count[~whole]
            counts[r, e], last[r, e] = count, t
        return counts, last, totals

    def _found(self, raw: np.ndarray, sizes: np.ndarray):
        """(row, start, end, token) of all tokens in the words: those of a word's end at its end only."""
        t, (n, width) = self.tokens, raw.shape
        row, start = np.nonzero(np.arange(width)[None, :] < sizes[:, None])
        node, out = np.zeros(len(row), np.int64), []
        for length in range(1, min(t.longest, width) + 1):
            inside = start + length <= sizes[row]
            row, start, node = row[inside], start[inside], node[inside]
            key = node * 256 + raw[row, start + length - 1]
            at = np.minimum(np.searchsorted(t.edge_keys, key), len(t.edge_keys) - 1)
            there = t.edge_keys[at] == key
            row, start, node = row[there], start[there], t.edge_to[at[there]]
            token = t.ends[(start + length == sizes[row]).astype(np.int64), node]
            some = token >= 0
            out.append((row[some], start[some], start[some] + length, token[some]))
            if not len(row):
                break
        return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))

    def alone(self, word: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """The same for one word of any length, without a place for every word of its width."""
        counts, last = np.zeros(len(word) + 1, np.int64), np.full(len(word) + 1, -1, np.int64)
        for end in range(1, len(word)):
            counts[end], last[end] = self.read(word, counts, last, end, 0)
        return counts, last, self.read(word, counts, last, len(word), 1)[0]

    def read(self, word: bytes, counts: np.ndarray, last: np.ndarray, end: int, kind: int) -> tuple[int, int]:
        """(tokens, last token) of the first `end` bytes, as a prefix inside a word or as a word."""
        known = self.tokens.tokens[kind]
        for start in range(max(0, end - self.tokens.longest), end):
            token = known.get(word[start:end])
            if token is not None and (start == 0 or self._apart(int(last[start]), token)):
                return int(counts[start]) + 1, token
        raise ValueError("a byte of the text is no token of the vocabulary")

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019
    def _apart(self, left: int, right: int) -> bool:
        return bool(self.tokens.compatible(np.array([left]), np.array([right]))[0])


class WordCounts:
    """Tokens of words, each distinct word's table filled once; forgets all when `most` are held."""

    def __init__(self, tokens: PrefixTokens, most: int = 250_000):
        self.tables, self.most, self.known = WordTables(tokens), most, {}

    def sizes(self, words: list) -> np.ndarray:
        """Number of tokens of each word; a special string is asked for as a one-tuple."""
        new = list(set(words).difference(self.known))
        if new:
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = list(set(words))
            plain = [w for w in new if isinstance(w, str)]
            self.known.update((w, 1) for w in new if not isinstance(w, str))
            self._fill(plain, [w.encode() for w in plain])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _fill(self, words: list[str], raw: list[bytes]) -> None:
        whole = self.tables.tokens.tokens[1]
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            if w in whole:  # one token, the last place of its table
                self.known[words[i]] = 1
            elif len(w) > LONG:
                self.known[words[i]] = self.tables.alone(w)[2]
            else:
                by_width.setdefault(-(-len(w) // 8) * 8, []).append(i)
        for width, places in by_width.items():
            most = TOGETHER // width
            for at in range(0, len(places), most):
                some = places[at : at + most]
                totals = self.tables.together([raw[i] for i in some])[2].tolist()
                self.known.update((words[i], total) for i, total in zip(some, totals, strict=True))


class PrefixCounts:
    """The running token count of one text: `ends[i]` (code points of the normalized text) has
    `counts[i]` tokens before it; special strings keep their own spelling in the normalized text."""

    def __init__(self, text: str, known: WordCounts):
        self.known = known
        split = special_splitter(known.tables.tokens.specials)
        self.text, words, ends = "", [], []
        for i, part in enumerate(split.split(text) if split else [text]):
            shown = part if i % 2 else normalized(part)
            base = len(self.text)
            if i % 2:
                words.append((part,))
                ends.append(base + len(part))
            else:
                for m in _WORDS.finditer(shown):
                    words.append(m[0])
                    ends.append(base + m.end())
            self.text += shown
        self.words, self.ends = words, np.array(ends, np.int64)
        self.counts = np.cumsum(known.sizes(words))
        self.tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _cut(self, word: str, size: int) -> int:
        """Tokens of the first `size` code points of a word, read from its table."""
        raw, tables = word.encode(), self.known.tables
        if word not in self.tables:
            self.tables[word] = tables.alone(raw)[:2]
        return tables.read(raw, *self.tables[word], len(word[:size].encode()), 1)[0]

    def at(self, end: int) -> int:
        """Tokens of the first `end` code points."""
        full = int(np.searchsorted(self.ends, end, "right"))
        total = int(self.counts[full - 1]) if full else 0
        if full < len(self.words):
            word = self.words[full]
            spelled = word[0] if isinstance(word, tuple) else word
            size = end - (int(self.ends[full]) - len(spelled))
            if size > 0 and isinstance(word, str) and _WORDS.fullmatch(word[:size]):
                total += self._cut(word, size)
            elif size > 0:  # a cut quote or special string falls apart into words
                total += int(self.known.sizes(_WORDS.findall(normalized(spelled[:size]))).sum())
        return total

    def fit(self, budget: int) -> int:
        """Code points up to the end of the last whole word that fits the budget."""
        full = int(np.searchsorted(self.counts, budget, "right"))
        return int(self.ends[full - 1]) if full else 0


def token_counts(
    df: DataFrame,
    tokenizer: str,
    text: str = "text",
    budgets: tuple[int, ...] = (),
    prefixes: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add `n_bytes` and `n_tokens` of every whole text.

    For each budget b, `words_in_<b>` says how many leading words fit into b tokens. With
    `prefixes`, `prefix_tokens` holds the running count after every word.
    """
    tokens = df.sparkSession.sparkContext.broadcast(PrefixTokens(tokenizer))  # the size of the vocabulary
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(f"words_in_{b}", T.LongType()) for b in budgets]
    if prefixes:
        fields.append(T.StructField("prefix_tokens", T.ArrayType(T.LongType(), False)))

    def prepare():
        known, split = WordCounts(tokens.value), special_splitter(tokens.value.specials)

        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            words: list = []
            ends = [0]
            for t in texts(piece.column(text)):
                if split is None or split.search(t) is None:
                    words += _WORDS.findall(normalized(t))
                else:
                    for i, part in enumerate(split.split(t)):
                        words += [(part,)] if i % 2 else _WORDS.findall(normalized(part))
                ends.append(len(words))
            upto = np.concatenate([[0], np.cumsum(known.sizes(words))])
            rows = np.array(ends)
            before = upto[rows[:-1]]
            out = [np.diff(text_bytes(piece.column(text))[1]), upto[rows[1:]] - before]
            # A row's words end at rows[1:]; sums grow, so one search over all rows finds each limit.
            for b in budgets:
                out.append(np.minimum(np.searchsorted(upto, before + b, "right") - 1, rows[1:]) - rows[:-1])
            arrays = [pa.array(o, pa.int64()) for o in out]
            if prefixes:
                runs = upto[1:] - np.repeat(before, np.diff(rows))
                kind = pa.list_(pa.field("element", pa.int64(), False))
                arrays.append(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(runs, pa.int64()), type=kind))
            return arrays

        return make

    return with_columns(df, text, fields, prepare, keep, most=PIECE)
