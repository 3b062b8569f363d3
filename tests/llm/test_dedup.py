"""Substring dedup, near-duplicates, exact search and the pipeline against brute force."""

import collections
import hashlib
import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from tallybrook.llm import blocks, near_dup, substring, topk


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def corpus(seed=5):
    rng = random.Random(seed)
    shared = prose(rng, 60)
    docs = [(i, prose(rng, rng.randrange(1, 200))) for i in range(60)]
    docs += [(100 + i, prose(rng, 30) + "\n" + shared + "\t" + prose(rng, 20)) for i in range(30)]
    docs += [(200 + i, docs[3][1]) for i in range(20)]
    base = prose(rng, 150).split()
    for i in range(25):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        docs.append((300 + i, " ".join(words)))
    docs += [(400, None), (401, ""), (402, "  \n"), (403, "one two"), (404, "one two"), (405, "again and " * 400), (406, "x " * 45), (None, shared), (407, shared + "é"), (408, prose(rng, 20_000, 10**6)), (5, "same id, other text " * 9)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, n_words string, idx int")


def brute_cut(docs):
    """Kept words of each row. Copies of a text follow by their place, rows of one id by their text's digest."""
    digest = lambda t: hashlib.blake2b((t or "").encode(), digest_size=16).digest()
    order = sorted(range(len(docs)), key=lambda r: (docs[r][0] is not None, docs[r][0] or 0, digest(docs[r][1])))
    seen, out = set(), {}
    for r in order:
        words = (docs[r][1] or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        out[r] = (docs[r][0], len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return sorted(out.values(), key=str)


def cut_rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, b" ".join((r.text or "").encode().split()).decode()) for r in df.collect()), key=str)


@pytest.mark.parametrize("group,size", [(1 << 17, 8 << 20), (3, 20_000)])
def test_substring_dedup(spark, monkeypatch, group, size):
    monkeypatch.setattr(substring, "GROUP", group)
    monkeypatch.setattr(blocks, "BYTES", size)
    docs = corpus()
    got = substring.dedup(frame(spark, docs))
    assert cut_rows(got) == brute_cut(docs)
    texts = dict(docs)
    for r in got.collect():
        if r.doc_id == 400:
            assert r.text is None
        elif not r.n_removed and r.doc_id not in (None, 5):
            assert r.text == texts[r.doc_id]


def test_rows_of_one_id_follow_by_their_text(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BYTES", 2000)
    rng = random.Random(11)
    shared = prose(rng, 40)
    docs = [(1, f"{shared} {prose(rng, 25 + i)}") for i in range(12)] + [(None, f"{prose(rng, 30)} {shared}") for _ in range(3)]
    found = [cut_rows(substring.dedup(frame(spark, rng.sample(docs, len(docs))).repartition(n))) for n in (1, 4, 9)]
    assert found[0] == found[1] == found[2] == brute_cut(docs)


def test_cuts_leave_the_white_space_of_what_stays():
    words = [f"w{i}" for i in range(24)]
    raw = ("\n" + "\t".join(words) + " \n").encode()
    assert substring.without(raw, None) == (raw, 24, 0) and substring.without(b" a  b", True) == (b" a  b", 2, 0)
    assert substring.without(raw, np.array([0])) == (b"w20\tw21\tw22\tw23 \n", 24, 20)
    assert substring.without(raw, np.array([2])) == (b"\nw0\tw1\tw22\tw23 \n", 24, 20)
    assert substring.without(raw, np.array([4])) == (b"\nw0\tw1\tw2\tw3", 24, 20)
    assert substring.without(raw, True) == (b"", 24, 24)


def test_unbroken_and_tiny_texts(spark):
    docs = [(1, "x" * 3_000_000), (2, "y" * 2_000_000 + " " + "z " * 30), (3, "z " * 25)] + [(10 + i, f"t{i % 700}") for i in range(20_000)]
    assert cut_rows(substring.dedup(frame(spark, docs))) == brute_cut(docs)
    kept = near_dup.label(frame(spark, docs)).filter("kept")
    assert kept.count() == 3 + 700


def test_substring_dedup_without_rows(spark):
    assert substring.dedup(frame(spark, []).select("doc_id", "text")).count() == 0


def test_prefixes_grow_until_they_fit():
    rng = random.Random(1)
    same = " ".join(f"c{i}" for i in range(5))
    s = substring.Suffixes([f"{same} {prose(rng, 40)}".encode() for _ in range(50)])
    stats = substring.Statistics()
    stats.keys([f"{same} {prose(random.Random(1), 40)}".encode() for _ in range(50)])
    at = s.first  # all texts start alike
    short = substring.prefixes(s, at, stats.sums().reshape(3, -1) > 50)
    grown = substring.prefixes(s, at, stats.sums().reshape(3, -1) > 49)
    assert len(set(short.tolist())) == 1 and len(set(grown.tolist())) == 50


def test_deep_nodes():
    prefix, label = np.array([1, 1, 2, 1, 2], np.uint64), np.array([5, 6, 5, 5, 5], np.uint64)
    by, node = substring.deep_nodes(prefix, label, (np.array([3, 1, 2, 0, 1]),))
    assert by.tolist() == [3, 0, 1, 4, 2] and node.tolist() == [0, 2, 3]


def word_hashes(raw, seed=1):
    starts, ends = blocks.split(raw)
    return blocks.hashes(raw, starts, ends, seed), starts, ends


def test_word_hashes():
    raw = "a bb\n\tccc  a\x0bbb é".encode()
    h, s, e = word_hashes(raw)
    assert [raw[a:b] for a, b in zip(s, e, strict=True)] == raw.split() and h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 4
    long = b"x" * (3 << 20) + b" y " + b"z " * 700_000
    h, s, e = word_hashes(long)
    assert len(h) == 700_002 and len(set(h.tolist())) == 3
    assert np.array_equal(blocks.grams(h, 3)[5:9], np.full(4, blocks.grams(h, 3)[5]))
    every = [b"abcdefgh", b"abcdefg", b"abcdefghi", b"abcdefgh\0", b"q" * 1024, b"q" * 1025, b"q" * 1026]
    assert len(set(word_hashes(b" ".join(every))[0].tolist())) == len(every)
    # a word and its complement by the parity of bits, which sums of powers modulo 2^64 can't tell apart
    thue = bytes(97 + bin(i).count("1") % 2 for i in range(1024))
    for seed in (1, 2, 3):
        assert len(set(word_hashes(thue + b" " + thue.translate(bytes.maketrans(b"ab", b"ba")), seed)[0].tolist())) == 2


def brute_classes(docs):
    """Classes of rows from tuples of words and their document frequencies, without the operator's hashes."""
    texts = [(t or "").split() for _, t in docs]
    df = collections.Counter(w for t in texts for w in set(t))
    idf = lambda shingle: 1 + math.log((len(docs) + 1) / (min(df[w] for w in shingle) + 1))
    sets = []
    for t in texts:
        found = collections.Counter(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))) if t else {}
        sets.append({k: n * idf(k) for k, n in found.items()})
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and sets[i].keys() & sets[j].keys():
            low = sum(min(w, sets[j].get(k, 0)) for k, w in sets[i].items())
            if low / (sum(sets[i].values()) + sum(sets[j].values()) - low) >= near_dup.LEAST:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


@pytest.mark.parametrize("cell", [256, 8])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(blocks, "BYTES", 20_000)
    monkeypatch.setattr(near_dup, "CELL", cell)
    docs = [d for d in corpus() if d[0] is not None] + [(500, "other " * 3), (501, "other " * 3)]
    docs = [(i if i != 5 or t.startswith("w") else 405_5, t) for i, t in docs]  # ids name rows
    got = near_dup.label(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    expected = {docs[i][0]: (min(docs[k][0] for k in g), len(g)) for g in brute_classes(docs) for i in g}
    assert {r.doc_id: (r.class_id, r.members) for r in got} == expected
    assert {r.doc_id for r in got if r.kept} == {c for c, _ in expected.values()}
    kept = near_dup.keep_first(frame(spark, docs))
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in expected.values()} and kept.columns == ["doc_id", "text", "n_words", "idx"]


def test_rows_of_one_id_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BYTES", 2000)
    rng = random.Random(12)
    one, other = prose(rng, 60), prose(rng, 60)
    docs = [(1, one), (1, other), (2, one), (3, other), (None, one), (None, "of its own " * 4), (4, None), (4, "")]
    got = near_dup.label(frame(spark, docs).repartition(5)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.members, r.kept) for r in got) == sorted([("1", "None", 3, False), ("2", "None", 3, False), ("None", "None", 3, True), ("1", "1", 2, True), ("3", "1", 2, False), ("None", "None", 1, True), ("4", "4", 1, True), ("4", "4", 1, True)])


def test_families_in_several_parts(spark, monkeypatch):
    """Chains: neighbours are similar, others only through them; chunks hold a few texts each."""
    monkeypatch.setattr(near_dup, "CELL", 4)
    rng = random.Random(8)
    docs, words = [], prose(rng, 120, 10**6).split()
    for i in range(70):
        docs.append((i, " ".join(words)))
        words = list(words)
        words[(i * 7) % 120] = f"new{i}"
    got = {r.doc_id: r.class_id for r in near_dup.label(frame(spark, docs)).collect()}
    expected = {docs[i][0]: min(docs[k][0] for k in g) for g in brute_classes(docs) for i in g}
    assert got == expected and len(set(got.values())) == 1


def joined_rows(spark, first):
    """Rows that joins have made in the executions from number ``first`` on."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(store.executionsList().size()):
        run = store.executionsList().apply(k).executionId()
        if run < first:
            continue
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())) if "Join" in node.name() else ():
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    made += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return made


def test_links_are_joined_a_few_times_only(spark):
    """Rings of cliques, their nodes numbered at random: what is joined follows the links, however long the rings are."""
    rng = random.Random(6)
    name = rng.sample(range(10**6), 1600)
    links = [(name[12 * k + a], name[(12 * k + b) % 1200]) for k in range(100) for a in range(12) for b in range(a + 1, 13)]
    links += [(name[1200 + i], name[1201 + i]) for i in range(398) if i != 150] + [(name[1599], name[1599])]
    df = spark.createDataFrame(links + links[:500], "u long, v long")
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    first = max((runs.apply(k).executionId() for k in range(runs.size())), default=-1) + 1
    got = {r.node: r.label for r in near_dup.components(df).collect()}
    parts = [name[:1200], name[1200:1351], name[1351:1599]]
    assert got == {i: min(p) for p in parts for i in p}
    assert joined_rows(spark, first) < 4 * len(links)
    assert near_dup.components(df.limit(0)).count() == 0


def test_memory_of_a_block(monkeypatch):
    """A block's words are hashed some at a time: results are those of all at once, in a part of the memory."""
    rng = np.random.default_rng(2)
    vocabulary = np.array([f"word{i}" for i in range(50_000)], object)
    texts = [" ".join(vocabulary[rng.integers(0, len(vocabulary), n)]).encode() for n in rng.integers(0, 900, 1000)]
    texts[7:7] = [b"", texts[3], b" ".join(texts[:400])]
    assert blocks.BYTES < sum(map(len, texts)) < 2 * blocks.BYTES
    idf = near_dup.weights(rng.integers(1, 1000, near_dup.BUCKETS), 1000)

    def made():
        frequencies, statistics = near_dup.Frequencies(), substring.Statistics()
        near_dup.draws()
        return [(of(texts), own) for of, own in ((frequencies.keys, frequencies.sums), (statistics.keys, statistics.sums), (lambda x: near_dup.band_keys(x, idf), lambda: 0))]

    peaks = []
    for of in (near_dup.Frequencies().keys, substring.Statistics().keys):
        tracemalloc.start()
        of(texts[:7] + texts[10:])
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
    assert max(peaks) < 36, peaks
    some = made()
    monkeypatch.setattr(blocks, "PART", 1 << 40)
    for (a, own_a), (b, own_b) in zip(some, made(), strict=True):
        assert np.array_equal(own_a(), own_b()) and (a is b is None or np.array_equal(a, b))
    assert [x for part in blocks.parts(texts) for x in part] == texts and not list(blocks.parts([]))


def test_near_duplicates_without_rows(spark):
    assert near_dup.label(frame(spark, [])).count() == 0
    assert near_dup.label(frame(spark, [(1, None), (2, ""), (3, "a b c d e f")])).filter("kept").count() == 3


def test_similarities_and_samples():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    raw, edits = [" ".join(base).encode()], (2, 5, 10, 20, 40)
    for n in edits:
        words = list(base)
        for _ in range(n):
            words[rng.randrange(400)] = f"e{rng.random()}"
        raw.append(" ".join(words).encode())
    raw += [b"dup dup dup dup dup dup dup dup", b"dup dup dup dup dup dup"]
    counted = near_dup.Frequencies()
    counted.keys(raw)
    idf = near_dup.weights(counted.sums(), len(raw))
    who, key, weight, one = near_dup.vectors(raw, idf)
    s = near_dup.similarities(who, key, weight, one, len(raw))
    sets = [dict(zip(key[who == i].tolist(), weight[who == i].tolist(), strict=True)) for i in range(len(raw))]
    for i, j in itertools.permutations(range(len(raw)), 2):
        low = sum(min(w, sets[j].get(k, 0)) for k, w in sets[i].items())
        assert abs(s[i, j] - low / (sum(sets[i].values()) + sum(sets[j].values()) - low)) < 1e-6
    assert abs(s[-1, -2] - 0.5) < 1e-6  # two windows of four: counts matter
    drawn = near_dup.bands(who, key, weight, len(raw))
    agree = (drawn[1:6] == drawn[0]).mean(axis=1)
    for i, a in enumerate(agree):  # a band agrees with the similarity's fourth power
        p = s[0, i + 1] ** near_dup.ROWS
        assert abs(a - p) <= 4 * math.sqrt(p * (1 - p) / near_dup.BANDS)


def test_samples_agree_as_often_as_sets_do():
    rng = random.Random(4)
    raw = []
    for i in range(60):
        words = prose(rng, 300 if i % 2 else 6000).split()
        raw.append(" ".join(words).encode())
        for k in rng.sample(range(len(words)), len(words) // 60):
            words[k] = f"e{rng.random()}"
        raw.append(" ".join(words).encode())
    counted = near_dup.Frequencies()
    counted.keys(raw)
    who, key, weight, one = near_dup.vectors(raw, near_dup.weights(counted.sums(), len(raw)))
    s, drawn = near_dup.similarities(who, key, weight, one, len(raw)), near_dup.bands(who, key, weight, len(raw))
    for kind in (0, 2):  # long texts, short texts
        at = range(kind, len(raw), 4)
        off = [(drawn[i] == drawn[i + 1]).mean() - s[i, i + 1] ** near_dup.ROWS for i in at]
        assert abs(sum(off) / len(off)) < 0.05


# exact search


def brute_search(rows, k, every):
    fine = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(fine):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for n, (c, w) in enumerate(fine) if n != at)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def found_in(df, every, **more):
    from pyspark.sql import functions as F

    return sorted(map(tuple, topk.search(df, F.col("vec_id") % every == 0, **more).collect()))


def test_search(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "STEP", 16)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.exponential()).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(80)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (310, []), (None, [1.0] * 8), (305, [9.0, 9.0]), (7, [0.0] * 8), (306, [0.0] * 8)]
    rows += [(400, [2.0, 0.0]), (400, [3.0, 0.0]), (400, [3.0, 0.0]), (7, [5.0] * 8)]
    df = vectors_frame(spark, rows)
    assert found_in(df, 10, k=5) == brute_search(rows, 5, 10)
    few = [r for r in rows if r[0] is not None and r[0] < 3]
    assert found_in(vectors_frame(spark, few), 10) == brute_search(few, 10, 10)
    for none in (df.limit(0), df.filter("vec_id = 1")):
        assert found_in(none, 10) == []


def test_search_with_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 10.0 ** (i % 4 * 2)).tolist()) for i in range(60)] + [(100, [1e6] * 6), (101, [-1e6] * 6), (101, [2.5e6] + [-1.0] * 5)]
    assert found_in(vectors_frame(spark, rows), 10) == brute_search(rows, 10, 10)
    with pytest.raises(Exception, match="too large"):
        found_in(vectors_frame(spark, [(0, [1e30]), (1, [1.0])]), 10)
    with pytest.raises(Exception, match="fit a long"):
        found_in(vectors_frame(spark, [(0, [1e8] * 4), (1, [1e9] * 4)]), 10)
    small = np.array([[1 << 61, 5]]), np.array([[1, 1 << 40]])
    assert topk.products(*small, safe=False).tolist() == [(1 << 61) + 5 * (1 << 40)]


def test_blocks_that_cannot_matter_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 32)
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(800, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    rows = [(i, (u * 2.0 ** (-i / 40)).tolist()) for i, u in enumerate(unit)]
    kept, scanned = topk._scanned, []
    monkeypatch.setattr(topk, "_scanned", lambda pairs, *a: scanned.append(pairs.count()) or kept(pairs, *a))
    assert found_in(vectors_frame(spark, rows), 100) == brute_search(rows, 10, 100)
    assert scanned[1] < 0.5 * 25 * scanned[0]


def test_pruning_leaves_pairs_out():
    rng = np.random.default_rng(4)
    c = (rng.normal(size=(2000, 32)) * rng.exponential(size=(2000, 1)) * np.linspace(3, 0.1, 32) * 200).astype(np.int32)
    values, basis = np.linalg.eigh(c.T.astype(float) @ c)
    c = c.astype(np.int64)
    best, done, _ = topk.scan(np.arange(20), c[:20], np.arange(2000), np.arange(2000), c, basis[:, ::-1], 12, np.full(20, topk.FLOOR), 10)
    scores = c[:20].astype(np.int64) @ c.T.astype(np.int64)
    np.fill_diagonal(scores, topk.FLOOR)
    assert sorted(best.s.tolist()) == sorted(np.sort(scores, axis=1)[:, -10:].ravel().tolist()) and done < 0.5 * 20 * 2000 and values[0] <= values[-1]


# pipeline


def test_pipeline(spark):
    rng = random.Random(9)
    docs = [(i, prose(rng, 120), "en", f"s{i % 3}", 1) for i in range(40)]
    docs += [(50, docs[0][1], "en", "s0", 1), (51, "short", "en", "s1", 1), (52, None, None, None, None), (53, "spam " * 80, "en", "s1", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    path = blocks.fresh_path(spark, "sf")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (*range(40), 50)] + [(53, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    at = spark.read.parquet(f"{path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.cut(stage(spark, at, path))
        sizes.append(at.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == df.columns
        if len(sizes) == 2:
            assert {r.doc_id for r in at.collect()} == set(range(40))
    assert sizes[0] == 41 and sizes[1] == 40 and sizes[2] == 40
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, at.collect())) and at.filter("not exact").count() == 0


def test_pipeline_keeps_texts_and_takes_odd_rows(spark):
    """White space, null ids and sources, repeated ids, columns named like those that stages make; and no rows."""
    rng = random.Random(10)
    lined = lambda n: "\n\t".join(prose(rng, 12) for _ in range(n)) + "\n"
    shared = prose(rng, 30)
    docs = [(i, lined(9), "s1", 0, i * 0.5, "kept") for i in range(12)] + [(None, lined(8), None, 0, None, None), (3, lined(10), "s2", None, 1.0, "x")]
    docs += [(20, f"{lined(6)}{shared}\n{lined(5)}", "s2", 0, 1.0, "x"), (21, f"{lined(7)}{shared}\t{lined(5)}", "s2", 0, 1.0, "x"), (22, None, "s1", 0, 1.0, "x"), (23, "", None, 0, 1.0, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars int, score double, n_words string")
    for rows in (df, df.limit(0)):
        path = blocks.fresh_path(spark, "sf")
        rows.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in (*range(12), 20, 21)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        at = spark.read.parquet(f"{path}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = corpus_pipeline.cut(stage(spark, at, path))
            assert k == 4 or at.columns == df.columns
            if k == 2 and rows is df:
                left = at.collect()
                texts = {t for _, t, *_ in docs}
                assert {*range(12), 20, 21} <= {r.doc_id for r in left} and all(r.n_chars == len(r.text) for r in left)
                assert {(r.source, r.score, r.n_words) for r in left} <= {(d[2], d[4], d[5]) for d in docs}
                assert [r.doc_id for r in left if r.text not in texts] == [21]
                cut_one = next(r for r in left if r.doc_id == 21)
                assert shared not in cut_one.text and cut_one.text.count("\n\t") == docs[15][1].count("\n\t")
        assert (at.count() > 0) == (rows is df)
