"""Token counts by rank-synchronous merging of byte-level BPE.

The pre-tokens of a batch lie in one flat array of symbols with an array of starts. In each round every
sequence merges all places of its lowest-ranked pair at once, sequences without a pair leave, and what symbols
survive are counted. Merging all places of the lowest pair is what merging them one by one gives: a pair that
holds a new symbol ranks behind the pair the symbol came from. In runs like ``aaa`` the left pair goes first.
Sequences longer than ``LONG`` go through the ranks together, the lowest first; there a round looks only at the
places of its rank and, behind the merges, at their neighbours, so an unbroken text doesn't cost its length a round.

Texts are cut where white space follows other characters, where no pre-token goes across. A batch counts each
different piece once, and what recent batches counted is kept (``common.Recent``, a bounded size).

Cases: a null text is empty: no bytes, no tokens. Very long texts are counted whole. A special string inside a
text is one token, as the library has it by default. Repeated rows are each counted. Columns that clash with
new ones are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import Recent, map_texts, tool

LIMIT = 1024
#: Bytes of a pre-token that merges by ranks instead of rounds.
LONG = 256
NONE = np.int64(1 << 40)
#: Unicode white space, as the library's patterns have it.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pre-tokens of byte-level BPE (fixed value).
PRE_TOKEN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
PIECE = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merger:
    """Counts the symbols that survive the merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        ids = model["vocab"]
        self.width = np.int64(max(ids.values()) + 1)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] * int(self.width) + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.of_byte = np.array([ids[c] for c in byte_symbols()], np.int32)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token."""
        out = np.zeros(len(tokens), np.int64)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            out[long] = self._by_rank([tokens[i] for i in long.tolist()])
            tokens = [t if len(t) <= LONG else b"" for t in tokens]
            sizes[long] = 0
        who = np.flatnonzero(sizes)
        sizes = sizes[who]
        flat = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        while len(who):
            starts = np.cumsum(sizes) - sizes
            at, rank = self._ranks(flat, starts)
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            out[who[over]] = sizes[over]
            hit = (rank == np.repeat(least, sizes)) & (rank != NONE)
            hit = self._apart(hit)
            flat[hit] = self.made[at[hit]]
            stay = np.repeat(~over, sizes)
            keep = stay.copy()
            keep[1:] &= ~hit[:-1]
            lost = np.add.reduceat(hit, starts)
            flat, who, sizes = flat[keep], who[~over], (sizes - lost)[~over]
        return out

    def _by_rank(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each long pre-token. Symbols are linked to their neighbours, places wait under their rank."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(sizes) - sizes
        flat = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        n = len(flat)
        at, rank = self._ranks(flat, starts)
        behind, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        behind[starts + sizes - 1] = -1
        before[starts] = -1
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            for some in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1) if len(places) else []:
                r = int(rank[some[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(some)

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            found = waiting.pop(r)
            hit = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            hit = hit[alive[hit] & (rank[hit] == r)]
            if not len(hit):
                continue
            # of hits that share a symbol every second one, from the left
            new = np.ones(len(hit), bool)
            new[1:] = behind[hit[:-1]] != hit[1:]
            turn = np.arange(len(hit))
            hit = hit[(turn - np.maximum.accumulate(np.where(new, turn, 0))) % 2 == 0]
            gone, after = behind[hit], behind[behind[hit]]
            flat[hit] = self.made[at[hit]]
            alive[gone] = False
            rank[gone] = NONE
            behind[hit] = after
            linked = after >= 0
            before[after[linked]] = hit[linked]
            left = before[hit]
            near = np.unique(np.concatenate((hit, left[left >= 0])))
            rank[near] = NONE
            near = near[behind[near] >= 0]
            key = flat[near] * self.width + flat[behind[near]]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            at[near[known]], rank[near[known]] = place[known], self.ranks[place[known]]
            wait(near)
        return np.add.reduceat(alive, starts, dtype=np.int64)

    def _ranks(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol, where its pair with the next stands in the table, and the pair's rank."""
        at, rank = np.zeros(len(flat), np.int64), np.full(len(flat), NONE)
        key = flat[:-1] * self.width + flat[1:]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[place] == key
        at[:-1], rank[:-1] = place, np.where(known, self.ranks[place], NONE)
        rank[starts[1:] - 1] = NONE  # the next symbol belongs to another sequence
        return at, rank

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Every second of hits that follow each other, from the left."""
        if not (hit[1:] & hit[:-1]).any():
            return hit
        i = np.arange(len(hit))
        before = np.maximum.accumulate(np.where(hit, -1, i))
        return hit & ((i - before) % 2 == 1)


class Counter:
    def __init__(self, path: str):
        import regex

        self.merger, self.pre, self.known = Merger(path), regex.compile(PRE_TOKEN), Recent(1 << 19)

    def __call__(self, texts: list[str]) -> list[int]:
        cut, special = self.merger.cut, self.merger.special
        pieces, extra = [], []
        for x in texts:
            if any(s in x for s in special):
                parts = cut.split(x)
                extra.append(len(parts) - 1)
                pieces.append([p for part in parts for p in PIECE.findall(part)])
            else:
                extra.append(0)
                pieces.append(PIECE.findall(x))
        known = self.known.of(set().union(*pieces), self._learn)
        return [n + sum(map(known.__getitem__, ps)) for ps, n in zip(pieces, extra, strict=True)]

    def _learn(self, new: list[str]) -> list[int]:
        tokens = [[t.encode() for t in self.pre.findall(p)] for p in new]
        counts = self.merger.count([t for ts in tokens for t in ts])
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        sums = np.concatenate(([0], np.cumsum(counts)))
        ends = np.cumsum(sizes)
        return (sums[ends] - sums[ends - sizes]).tolist()


def counter(path: str) -> Counter:
    return tool(("counter", path), lambda: Counter(path))


def count(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` without its text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""

    def make():
        c = counter(path)
        return lambda texts: [(len(x.encode()), n, n > limit) for x, n in zip(texts, c(texts), strict=True)]

    return map_texts(docs, text, [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")], make)
