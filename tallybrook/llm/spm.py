"""SentencePiece encoding and decoding by suffix-array matching.

The new pieces of text of a batch are strung together and indexed by a suffix array (to the depth of the
longest vocabulary entry). Every entry is binary-searched for the range of suffixes that start with it; the
occurrences are the edges of a lattice. Sorted by position, they are relaxed from left to right.

For the BPE models that sentencepiece makes, relaxing goes by this rule: of all edges that end at a place,
exactly one can end the encoding of the text up to there, namely the one that stands unmerged next to the edge
that ends where it starts. Two entries stand unmerged if undoing their own merges from the last backwards
never shows a pair over their border that would have merged before. So each place gets one edge, and
following them back from the end gives the ids.

Texts are cut before runs of spaces and around line ends, where no entry goes across. A batch encodes each different
piece once and holds it once, and the ids of what recent batches encoded are kept (``common.Recent``, a bounded
size); each text is decoded from its ids. After a batch, freed memory goes back to the system. Runs of spaces, whose
entries all have one score, merge from the left as the library does it. Pieces of more than ``LONG`` characters are
indexed in windows of ``INDEXED`` and relaxed character by character, with what is known of two entries kept.

Cases: a null text is empty and has no ids. Characters outside the vocabulary become their bytes. Very long
texts are encoded whole. Decoding gives back the text but for U+2581, which becomes a space. Repeated rows are
each encoded. Columns that clash with new ones are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .common import Recent, map_texts, release, tool

#: Characters of new text that are indexed at once, and of a piece that isn't relaxed together with others.
INDEXED, LONG = 1 << 17, 1 << 11
#: Pairs of entries of long pieces that are remembered.
PAIRS = 1 << 17
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
START, OUTSIDE, UNREACHED = -1, -2, -3
FAR = np.int64(1 << 40)


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = [next((i for i in range(n) if sp.is_byte(i) and self.pieces[i] == f"<0x{b:02X}>"), None) for b in range(256)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.ids = {self.pieces[i]: i for i in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}|\n|{SPACE}{SPACE}[^{SPACE}]", p) for p in self.ids):
            raise ValueError("the vocabulary has entries that go across spaces or line ends")
        # what an id stands for in the decoded text
        self.plain = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.bytes):
            if i is not None:
                self.plain[i] = bytes([b])
        words = [p for p in self.ids if len(p) == 1 or p.strip(SPACE)]
        order = sorted(words, key=lambda p: -self.score[p])
        if len({self.score[p] for p in words if len(p) > 1}) != sum(len(p) > 1 for p in words):
            raise ValueError("entries of equal score: not a BPE model")
        rank = {p: r for r, p in enumerate(order)}
        self.width = np.int64(n)
        # every way to put an entry together, and the entry's last merge
        pairs, self.left, self.right = {}, np.arange(n), np.arange(n)
        self.rank = np.full(n, -1, np.int64)
        usable = []
        for p in words:
            i = self.ids[p]
            if len(p) > 1:
                self.rank[i] = rank[p]
                for k in range(1, len(p)):
                    if p[:k] in rank and p[k:] in rank:
                        pairs[self.ids[p[:k]] * n + self.ids[p[k:]]] = rank[p]
                parts, last = self.merged(p)
                if parts != [p]:
                    continue  # no text ever gets it
                self.left[i], self.right[i] = self.ids[last[0]], self.ids[last[1]]
            usable.append(p)
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        # characters as 16-bit codes: 0 between texts, 1 for any outside the vocabulary
        chars = sorted({c for p in usable for c in p})
        if len(chars) > 65_000:
            raise ValueError("more characters than codes")
        self.codes = np.ones(0x110000, ">u2")
        self.codes[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.depth = max(map(len, usable))
        self.sizes = np.ones(n, np.int64)
        self.entries = np.array([self.ids[p] for p in usable], np.int64)
        self.sizes[self.entries] = [len(p) for p in usable]
        self.low = np.array([self._key(p, 0) for p in usable], f"S{2 * self.depth}")
        self.high = np.array([self._key(p, 0xFFFF) for p in usable], f"S{2 * self.depth}")
        self.runs: dict[int, list[int]] = {}
        self.remembered: dict[int, bool] = {}
        self.ranks = None

    def _key(self, piece: str, fill: int) -> bytes:
        return self.codes[[ord(c) for c in piece]].tobytes() + bytes([fill & 0xFF]) * (2 * (self.depth - len(piece)))

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The plain way: merge the best pair, the left one of equals, until there is none. Also the last merge."""
        parts, last = list(text), None
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts, last
            i = -best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def run(self, n: int) -> list[int]:
        """The ids of n spaces on their own. They merge from the left, so what is left of a long run repeats."""
        if n not in self.runs:
            longest = max(len(p) for p in self.ids if not p.strip(SPACE))
            if n > 8 * longest:
                first = self.merged(SPACE * (4 * longest))[0]
                if set(first) == {SPACE * longest}:
                    return [self.ids[SPACE * longest]] * ((n - 4 * longest) // longest) + self.run(n - (n - 4 * longest) // longest * longest)
            ids = [self.ids[p] for p in self.merged(SPACE * n)[0]]
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[n] = ids
        return self.runs[n]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether entry b stands unmerged behind entry a."""
        keys, back = np.unique(a * self.width + b, return_inverse=True)
        a, b = keys // self.width, keys % self.width
        fine, open_ = np.ones(len(keys), bool), np.arange(len(keys))
        limit = np.full(len(keys), FAR)
        while len(open_):
            key = a * self.width + b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            bad = (self.pairs[at] == key) & (2 * self.pair_rank[at] < limit)
            fine[open_[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))  # something is left to undo
            a, b, ra, rb, open_ = a[go], b[go], ra[go], rb[go], open_[go]
            first = ra > rb  # what merged last is undone first
            limit = np.where(first, 2 * ra, 2 * rb + 1)  # of equal pairs the left one merges, so one inside b gives way
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return fine[back]

    def edges(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where entries occur in ``codes`` from the first ``n`` places on, and which; as the suffix array has them."""
        padded = np.concatenate((codes, np.zeros(self.depth + 4, codes.dtype))).astype(">u2")  # bytes compare as codes do
        order = suffixes(padded.astype(np.uint64), len(codes), self.depth)
        order = order[order < n] if n < len(codes) else order
        keys = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[order].view(f"S{2 * self.depth}").ravel()
        first, last = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        many = last - first
        where = order[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        entry = np.repeat(self.entries, many)
        outside = np.flatnonzero(codes[:n] == 1)
        return np.concatenate((where, outside)), np.concatenate((entry, np.full(len(outside), OUTSIDE)))

    def whole(self, text: str) -> list[int]:
        """The ids of one long text: indexed window by window, relaxed place by place."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n, width, pairs, sizes = len(points), int(self.width), self.remembered, self.sizes.tolist()
        best = [UNREACHED] * (n + 1)
        best[0] = START
        for low in range(0, n, INDEXED):
            high = min(n, low + INDEXED)
            where, entry = self.edges(self.codes[points[low : high + self.depth]], high - low)
            by = np.argsort(where, kind="stable")
            entry, begin = entry[by].tolist(), np.searchsorted(where[by], np.arange(high - low + 1)).tolist()
            for s in range(low, high):
                before = best[s]
                if before == UNREACHED:
                    continue
                for k in range(begin[s - low], begin[s - low + 1]):
                    t = entry[k]
                    if t < 0 or before < 0:
                        best[s + (sizes[t] if t >= 0 else 1)] = t
                        continue
                    key = before * width + t
                    fine = pairs.get(key)
                    if fine is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fine = pairs[key] = self.apart_one(before, t)
                    if fine:
                        best[s + sizes[t]] = t
        ids, at = [], n
        while at:
            t = best[at]
            if t < OUTSIDE:
                raise RuntimeError("a place without an edge: not a BPE model")
            at -= sizes[t] if t >= 0 else 1
            ids += [t] if t >= 0 else [self.bytes[b] for b in reversed(text[at].encode())]
        return ids[::-1]

    def apart_one(self, a: int, b: int) -> bool:
        """``apart`` of two entries."""
        if self.ranks is None:
            self.ranks = dict(zip(self.pairs.tolist(), self.pair_rank.tolist(), strict=True)), self.rank.tolist(), self.left.tolist(), self.right.tolist()
        (of_pair, rank, left, right), width, limit = self.ranks, int(self.width), int(FAR)
        while True:
            if 2 * of_pair.get(a * width + b, limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = 2 * ra, right[a]
            else:
                limit, b = 2 * rb + 1, left[b]

    def segment(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts without inner spaces or line ends (one leading space may be)."""
        if not texts:
            return []
        if any(len(x) > LONG for x in texts):
            short = iter(self.segment([x for x in texts if len(x) <= LONG]))
            return [self.whole(x) if len(x) > LONG else next(short) for x in texts]
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1)[: len(texts)] - 1
        starts = ends - sizes
        codes = self.codes[points]
        codes[ends] = 0
        where, entry = self.edges(codes, len(codes))
        # edges by their distance from the start of their text: those of one distance don't depend on each other
        begin = np.repeat(starts, sizes + 1)
        far = where - begin[where]
        by = np.argsort(far, kind="stable")
        where, entry, far = where[by], entry[by], far[by]
        ends_at = np.append(self.sizes, [1] * 3)  # also of the negative marks
        best = np.full(len(codes) + 1, UNREACHED, np.int64)
        best[starts] = START
        for lo, hi in zip(*(np.searchsorted(far, np.arange(far[-1] + 1 if len(far) else 0), side) for side in ("left", "right")), strict=True):
            s, t = where[lo:hi], entry[lo:hi]
            before = best[s]
            fine = before != UNREACHED
            check = np.flatnonzero((before >= 0) & (t >= 0))
            if len(check):
                fine[check] = self.apart(before[check], t[check])
            best[s[fine] + ends_at[t[fine]]] = t[fine]
        # back from the ends
        at, who, steps = ends.copy(), np.arange(len(texts)), []
        while True:
            go = at > starts[who]
            at, who = at[go], who[go]
            if not len(at):
                break
            t = best[at]
            if (t < OUTSIDE).any():
                raise RuntimeError("a place without an edge: not a BPE model")
            at = at - ends_at[t]
            steps.append((who, at, t))
        if not steps:
            return [[] for _ in texts]
        who, at, t = (np.concatenate(x) for x in zip(*steps, strict=True))
        by = np.lexsort((at,))  # places are in the order of the texts
        who, at, t = who[by], at[by], t[by].tolist()
        ids, counts = [], np.bincount(who, minlength=len(texts))
        chars, upto = at.tolist(), 0
        for k in counts.tolist():
            own = t[upto : upto + k]
            if OUTSIDE in own:
                own = [i for x, p in zip(own, chars[upto : upto + k], strict=True) for i in ((x,) if x >= 0 else [self.bytes[b] for b in joined[p].encode()])]
            ids.append(own)
            upto += k
        return ids


def suffixes(codes: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The suffix array of the first n places, sorted to ``depth`` codes at least: by four, then by doubled ranks."""
    key, size = codes[:n] << np.uint64(48), 4
    for d in range(1, 4):
        key |= codes[d : n + d] << np.uint64(48 - 16 * d)
    while True:
        order = np.argsort(key)
        rank = np.zeros(n + size, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0) + 1
        if size >= depth or rank.max(initial=0) == n:
            return order
        key, size = rank[:n] * (n + 1) + rank[size:], 2 * size


class Codec:
    def __init__(self, path: str):
        self.model, self.known = Model(path), Recent(3 << 16)
        self.kind = "H" if self.model.width <= 1 << 16 else "I"

    def units(self, text: str) -> list[str]:
        return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of each unit, as bytes."""
        m, out = self.model, []
        upto = np.cumsum(np.fromiter(map(len, new), np.int64, len(new))) // INDEXED
        for some in np.split(np.array(new, object), np.flatnonzero(np.diff(upto)) + 1):
            some = some.tolist()
            # spaces before the last one of a run belong to the run, not to the word
            cores = [u if u[0] != SPACE and u != "\n" or u[0] == SPACE and u[1:2] not in (SPACE, "") else "" if u == "\n" or not u.strip(SPACE) else SPACE + u.lstrip(SPACE) for u in some]
            for u, core, ids in zip(some, cores, m.segment(cores), strict=True):
                if core is not u:
                    ids = self._with_run(u, core, ids)
                out.append(array(self.kind, ids).tobytes())
        return out

    def _with_run(self, unit: str, core: str, ids: list[int]) -> list[int]:
        m = self.model
        if unit == "\n":
            return [m.bytes[10]]
        n = len(unit) - len(unit.lstrip(SPACE)) - bool(core)
        if core and ids[0] == m.ids[SPACE]:  # a space that joined no word belongs to the run
            n, ids = n + 1, ids[1:]
        return m.run(n) + ids if n else ids

    def both(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of each text (bytes) and the UTF-8 of the text decoded from them."""
        seen: dict[str, str] = {}  # units that repeat are one string
        units = [list(map(seen.setdefault, us, us)) for us in map(self.units, texts)]
        found, plain, rows = self.known.of(set(seen), self.learn).__getitem__, self.model.plain.__getitem__, []
        for us in units:
            ids = b"".join(map(found, us))
            rows.append((ids, b"".join(map(plain, array(self.kind, ids)))[1:]))
        return rows

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u2" if self.model.width <= 1 << 16 else "<u4") for ids, _ in self.both(texts)]

    def decode(self, ids) -> str:
        """The text of ids, as the library gives it: without the space set before the text."""
        plain = self.model.plain
        return b"".join([plain[i] for i in ids])[1:].decode(errors="replace")


def codec(path: str) -> Codec:
    return tool(("codec", path), lambda: Codec(path))


def encode_decode(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` without its text, with n_tokens, ids_crc32 (of ids as little-endian 32-bit numbers), decoded_crc32
    and n_decoded (of the decoded text's UTF-8), exact (it equals the text); with ``with_ids`` also ids (binary,
    16 or 32 bits each) and decoded."""
    fields = [("n_tokens", "bigint"), ("ids_crc32", "bigint"), ("decoded_crc32", "bigint"), ("n_decoded", "bigint"), ("exact", "boolean")]
    fields += [("ids", "binary"), ("decoded", "string")] * 1 if with_ids else []

    def make():
        c = codec(path)
        kind = np.dtype("<u2" if c.model.width <= 1 << 16 else "<u4")

        def work(texts: list[str]) -> list[tuple]:
            rows = []
            for x, (ids, back) in zip(texts, c.both(texts), strict=True):
                flat = np.frombuffer(ids, kind)
                row = (len(flat), zlib.crc32(flat.astype("<u4").tobytes()), zlib.crc32(back), len(back), back == x.encode())
                rows.append((*row, ids, back.decode()) if with_ids else row)
            release()
            return rows

        return work

    return map_texts(docs, text, fields, make)
