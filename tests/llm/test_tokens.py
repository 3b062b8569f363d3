"""Token counts, id files and SentencePiece against the libraries themselves."""

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tallybrook.llm import arrow_ids, bpe_count, spm  # noqa: E402
from tallybrook.llm.common import Recent, fresh_path  # noqa: E402

BYTE, WORDS, PIECES = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "\n", "  x \n\n y\t", "aaa aaaa aaaaa", "don't we'll I'VE 's", "<|endoftext|>a <|endoftext|> b<|endoftext|>", "漢字 テスト　x y\x1c.\x1dz", "٣٤ 12³ ½", "😀😀 é é İstanbul ΑΣ ß ﬁ",
    "a b\x85c", "\r\n x", "THE-END... (foo) 3,000.50", "a" * 3000, " " * 301 + "x", "<0x0A> <s></s><unk>", "a▁b ▁▁c", "x\0y \0", "Heniii iiiii", "▁",
]


def texts(n=400, seed=1):
    rng = random.Random(seed)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x250), rng.randrange(0x300, 0x3000), rng.randrange(0x4E00, 0x9000), 0x20, 0x20, 0x0A, *map(ord, "etaoinshr")]))
    return ODD + ["".join(pick() for _ in range(rng.randrange(90))) for _ in range(n)] + ["".join(rng.choice("etaoin  shrdlu") for _ in range(rng.randrange(150))) for _ in range(n)]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n_tokens int, extra string")


def test_counts_equal_the_library():
    every = texts()
    assert bpe_count.Counter(BYTE)(every) == [len(e.ids) for e in library(BYTE).encode_batch(every, add_special_tokens=False)]


def test_count_query(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "é"), (4, "word " * 2000)]
    out = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_count.count(frame(spark, rows), BYTE).collect()}
    assert out == {(1, 0, 0, False), (2, 0, 0, False), (3, 11, 2, False), (None, 2, 1, False), (4, 10_000, 2001, True)}
    got = bpe_count.count(frame(spark, rows), BYTE)
    assert got.count() == 6 and "extra" in got.columns and bpe_count.count(frame(spark, rows[:0]), BYTE).count() == 0


def test_words_are_kept_for_two_generations(monkeypatch):
    monkeypatch.setattr(arrow_ids, "KEPT", 20)
    w, tok = arrow_ids.Words(WORDS), library(WORDS)
    for i in range(200):
        text = f"one two{i % 30} three{i} The, the"
        assert np.frombuffer(w.encode(text.encode()), np.uint16).tolist() == tok.encode(text, add_special_tokens=False).ids
        assert len(w) < 40 and len(w.past) < 40
    w.encode(b"z" * 100)
    assert b"z" * 100 not in w


def test_words_equal_the_library():
    w, every = arrow_ids.Words(WORDS), texts(seed=2)
    assert [np.frombuffer(x, np.uint16).tolist() for x in (w.encode(x.encode()) for x in every)] == [e.ids for e in library(WORDS).encode_batch(every, add_special_tokens=False)]


def test_id_files(spark):
    rows = [(i * 7 % 50, t) for i, t in enumerate(texts(10, 3)[:50])] + [(None, "none"), (3, "again"), (60, None), (61, "long words " * 3000)]
    df = frame(spark, rows)
    out = fresh_path(spark, "test")
    manifest = arrow_ids.write(df.repartition(5), WORDS, out, length=64, rows=8).cache()
    got = sorted(arrow_ids.read(manifest).collect(), key=lambda r: r.start)
    tok, at = library(WORDS), 0
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    by = {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        by.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in by[r.doc_id] and r.start == at
        at += r.n_tokens
    # sequences: views of the mapped file, masked behind the last token
    for m in manifest.collect():
        shard = arrow_ids.Shard(m.uri)
        seqs = [shard[i] for i in reversed(range(len(shard)))][::-1]
        assert all(len(ids) == 64 for ids, _ in seqs) and sum(int(mask.sum()) for _, mask in seqs) == m.tokens
        for view in seqs[0]:
            assert not view.flags.owndata and not view.flags.writeable
        assert seqs[0][1].dtype == bool
        flat = np.concatenate([ids[mask] for ids, mask in seqs])
        assert np.array_equal(flat, np.concatenate(list(shard.spans(0, m.tokens))))
        del seqs, flat
    assert arrow_ids.store(df.limit(0), WORDS).count() == 0


def test_shards_of_bounded_size(spark, monkeypatch):
    """Shards end at a bound; from a store that can't be mapped, batches are read one by one; equal rows in bulk."""
    monkeypatch.setattr(arrow_ids, "TOKENS", 500)
    df = frame(spark, [(7, "same words here")] * 6000 + [(8, "last one")])
    manifest = arrow_ids.write(df, WORDS, fresh_path(spark, "test"), length=16, rows=4).cache()
    shards = manifest.collect()
    assert len(shards) > 1 and max(m.docs for m in shards) < 6000
    tokens = len(library(WORDS).encode("same words here", add_special_tokens=False).ids) + 1
    got = sorted(arrow_ids.read(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [tokens * i for i in range(6001)] and len({r.ids_crc32 for r in got[:-1]}) == 1

    import pyarrow as pa

    reads = []

    class Remote:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, path):
            raw = self.store.open_input_file(path)

            class Counted:
                closed = False

                def __getattr__(self, name):
                    return getattr(raw, name)

                def read(self, n=-1):
                    reads.append(n)
                    return raw.read(n)

            return pa.PythonFile(Counted(), "r")

    local = arrow_ids.Shard(shards[0].uri)
    plain = [(ids.tolist(), mask.tolist()) for ids, mask in (local[i] for i in range(len(local)))]
    kept = arrow_ids.files
    monkeypatch.setattr(arrow_ids, "files", lambda uri: (Remote(kept(uri)[0]), kept(uri)[1]))
    shard = arrow_ids.Shard(shards[0].uri)
    before = len(reads)
    middle = len(plain) // 2
    ids, mask = shard[middle]
    assert (ids.tolist(), mask.tolist()) == plain[middle] and 0 < sum(reads[before:]) < 4 * shard.size and shard.n_batches > 4


@pytest.mark.parametrize("text", ["".join(random.Random(1).choices("etaoinshrdlucm", k=200_000)), "a" * 100_001, "ab" * 5000 + "漢" * 3000, " " * 9999 + "na" * 2777 + "é" * 999, "=" * 12_345, "\n" * 30_000])
def test_unbroken_texts(text):
    """A text without a space takes the time of its length, not its square, and the library's ids."""
    import time

    import sentencepiece

    began = time.time()
    n, codec = bpe_count.Counter(BYTE)([text])[0], spm.codec(PIECES)
    assert n == len(library(BYTE).encode(text, add_special_tokens=False).ids)
    assert codec.encode([text])[0].tolist() == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)
    assert time.time() - began < 30


def test_long_and_short_pieces_together():
    rng = random.Random(6)
    every = ["".join(rng.choices("etaoin shrdlu漢▁é", k=k)) for k in (10, 300, 3000, 9000)] + ["".join(rng.choices("etaoinshrdlu漢é", k=k)) for k in (1, 2100, 256, 257, 5000)]
    import sentencepiece

    assert [x.tolist() for x in spm.codec(PIECES).encode(every)] == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(every)
    assert bpe_count.Counter(BYTE)(every) == [len(e.ids) for e in library(BYTE).encode_batch(every, add_special_tokens=False)]


def test_windows_of_long_pieces(monkeypatch):
    monkeypatch.setattr(spm, "INDEXED", 700)
    monkeypatch.setattr(spm, "PAIRS", 50)
    text = "".join(random.Random(2).choices("etaoinshrdlu漢é", k=6000))
    import sentencepiece

    assert spm.codec(PIECES).model.whole("▁" + text) == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)


def test_suffix_arrays():
    rng = random.Random(9)
    for n, letters in ((1, 3), (50, 2), (3000, 2), (3000, 60_000)):
        codes = [rng.randrange(2, 2 + letters) for _ in range(n)]
        order = spm.suffixes(np.array(codes + [0] * 20, np.uint64), n, 16)
        keys = [tuple((codes + [0] * 16)[i : i + 16]) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)


def test_recent_values():
    asked = []
    make = lambda keys: asked.extend(keys) or [k * 2 for k in keys]
    r = Recent(3)
    for keys in ("ab", "bc", "cde", "abx", "x" * 1, "fghijk", "fa"):
        found = r.of(set(keys), make)
        assert all(found[k] == k * 2 for k in keys) and len(r.now) <= 3 and len(r.past) <= 3
    long = "y" * 100
    assert r.of({long}, make)[long] == long * 2 and long not in r.now and len(asked) < 25


def test_sentencepiece_equals_the_library():
    import sentencepiece

    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), spm.codec(PIECES)
    every = texts(seed=4) + [" " * k + "é" for k in range(1, 40)]
    got = codec.encode(every)
    assert [g.tolist() for g in got] == sp.encode(every)
    assert [codec.decode(g) for g in got] == [sp.decode(g.tolist()) for g in got]


def test_memory_of_pieces():
    """A batch holds a piece that repeats once, and of what it has encoded the ids alone stay."""
    import tracemalloc

    codec, rng = spm.Codec(PIECES), random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=8)) for _ in range(20_000)]
    codec.both([words[0]])
    tracemalloc.start()
    try:
        codec.both([" ".join(words)])
        kept = tracemalloc.get_traced_memory()[0]
        texts = [" ".join(rng.choices(words, k=200)) for _ in range(1000)]
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        rows = codec.both(texts)
        most = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert [back.decode() for _, back in rows] == texts
    assert kept < 190 * len(words) and most < 15_000_000, (kept / len(words), most)


def test_sentencepiece_query(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "a▁b"), (4, "word \n" * 3000)]
    got = spm.encode_decode(frame(spark, rows), PIECES, with_ids=True).collect()
    assert len(got) == 6
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        ids = sp.encode(text)
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded == text.replace("▁", " ") and r.exact == ("▁" not in text) and r.decoded_crc32 == zlib.crc32(r.decoded.encode())
    assert spm.encode_decode(frame(spark, rows[:0]), PIECES).count() == 0
