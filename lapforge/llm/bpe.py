"""Byte-pair merges by a segment tree over the ranks of adjacent pairs.

Every leaf of the tree holds the rank of the pair of its symbol and the next one, every
inner node the least of its two children, with the place in the low bits: the root is the
leftmost pair of lowest rank. A merge changes three leaves, each in logarithmic time, until
the root holds no mergeable pair. Many short words share one array of trees, a row each, and
take their merges in lockstep; a long word has a tree of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import regex

NONE = np.int64(1) << 62
LONG = 256  # symbols from which a word gets its own tree
ROOM = 1 << 18  # leaves in one array of trees


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = dict(zip(plain, map(chr, plain), strict=True))
    letters.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [letters[b] for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a tokenizer file, as plain arrays that can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[c] for c in letters], np.int64)  # symbol of a byte
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)  # of a word's last byte
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.merged = merged  # by rank
        size = max(max(vocab.values()), *self.specials.values()) + 1
        back = {c: b for b, c in enumerate(letters)}
        spelled = [b""] * size
        for token, at in vocab.items():
            if not suffix:
                spelled[at] = bytes(back[c] for c in token)
        for token, at in self.specials.items():
            spelled[at] = token.encode()
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, NONE without one."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def symbols(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        out = self.first[raw]
        out[-1] = self.last[raw[-1]]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words, one after another in their order, and the number for each."""
        lengths = np.array([len(w) for w in words], np.int64)
        parts: list[np.ndarray | None] = [None] * len(words)
        width = 1
        while width < LONG:
            width *= 2
            group = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 2 else 0)))
            for start in range(0, len(group), ROOM // width):
                rows = group[start : start + ROOM // width]
                ids, counts = self._together([words[i] for i in rows], lengths[rows], width)
                for i, part in zip(rows, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    parts[i] = part
        for i in np.flatnonzero(lengths > LONG):
            parts[i] = self._alone(self.symbols(words[i]))
        counts = np.array([len(p) for p in parts], np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), counts

    def _together(self, words: list[bytes], lengths: np.ndarray, width: int):
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        symbol = self.first[raw]
        every = np.arange(n)
        symbol[every, lengths - 1] = self.last[raw[every, lengths - 1]]
        place = np.arange(width)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        ranks = self.rank(symbol[:, :-1], symbol[:, 1:])
        ranks[place[1:][None, :] >= lengths[:, None]] = NONE
        tree[:, width:-1] = np.where(ranks < NONE, ranks * width + place[:-1], NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        gone = place[None, :] >= lengths[:, None]

        def put(rows, at, left, right, there):
            """Set the leaf `at` to the rank of its pair (none where not `there`) and mend its ancestors."""
            rank = self.rank(left, right)
            tree[rows, width + at] = np.where(there & (rank < NONE), rank * width + at, NONE)
            node = (width + at) >> 1
            while node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node >>= 1

        rows = every[tree[:, 1] < NONE]
        while len(rows):
            root = tree[rows, 1]
            rank, at = root // width, root % width
            old = after[rows, at]
            then = after[rows, old]
            symbol[rows, at] = self.merged[rank]
            gone[rows, old] = True
            after[rows, at] = then
            inner = then < lengths[rows]
            before[rows[inner], then[inner]] = at[inner]
            tree[rows, width + old] = NONE
            put(rows, old, symbol[rows, old], symbol[rows, old], np.zeros(len(rows), bool))
            put(rows, at, symbol[rows, at], symbol[rows, np.minimum(then, width - 1)], inner)
            prior = before[rows, at]
            has = prior >= 0
            if has.any():
                r, p = rows[has], prior[has]
                put(r, p, symbol[r, p], symbol[r, at[has]], np.ones(len(r), bool))
            rows = rows[tree[rows, 1] < NONE]
        return symbol[~gone], (~gone).sum(1)

    def _alone(self, symbol: np.ndarray) -> np.ndarray:
        n = len(symbol)
        width = 1 << (n - 1).bit_length()
        ranks = self.rank(symbol[:-1], symbol[1:])
        leaves = np.full(width, NONE, np.int64)
        leaves[: n - 1] = np.where(ranks < NONE, ranks * width + np.arange(n - 1), NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [0, *np.concatenate(levels[::-1]).tolist()]
        symbols, after, before = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        keys = getattr(self, "_pairs", None)
        if keys is None:
            keys = self._pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        none, merged, gone = int(NONE), self.merged, set()

        def put(at: int, rank: int | None) -> None:
            tree[width + at] = none if rank is None else rank * width + at
            node = (width + at) >> 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            old = after[at]
            then = after[old]
            symbols[at] = int(merged[rank])
            gone.add(old)
            after[at] = then
            put(old, None)
            if then < n:
                before[then] = at
                put(at, keys.get(symbols[at] << 20 | symbols[then]))
            else:
                put(at, None)
            if before[at] >= 0:
                put(before[at], keys.get(symbols[before[at]] << 20 | symbols[at]))
        return np.array([s for i, s in enumerate(symbols) if i not in gone], np.int64)


class WordIds:
    """Ids of words, each distinct word merged once; forgets all when `most` words are held.

    A special string is asked for as a one-tuple, so that it is no ordinary word.
    """

    def __init__(self, merges: Merges, most: int = 250_000):
        self.merges, self.most = merges, most
        self._clear()

    def _clear(self) -> None:
        specials = self.merges.specials
        self.index: dict = {(content,): i for i, content in enumerate(specials)}
        self.ids = np.array(list(specials.values()), np.int64)
        self.starts, self.counts = np.arange(len(specials)), np.ones(len(specials), np.int64)

    def lookup(self, words: list) -> np.ndarray:
        """Places of the words in `counts` and `starts`, until the next call."""
        new = list(set(words).difference(self.index))
        if new:
            if len(self.index) + len(new) > self.most:
                self._clear()
                new = list(set(words).difference(self.index))
            ids, counts = self.merges.encode([w.encode() for w in new])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def sizes(self, words: list) -> np.ndarray:
        """Number of tokens of each word."""
        at = self.lookup(words)
        return self.counts[at]

    def flat(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one after another."""
        counts = self.counts[at]
        shift = np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts)
        return self.ids[shift + np.arange(len(shift))]


def special_splitter(specials: Iterable[str]):
    """A pattern whose split keeps special strings at odd places; None without specials."""
    specials = sorted(specials, key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
