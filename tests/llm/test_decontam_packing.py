import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.llm import decontam, packing, workspace
from engram.llm.queries import QUERIES
from engram.llm.tokens import default_path, encoder


def slow_tiles(a, b, least):
    """Longest free common run first, earliest in a, then in b, until none of ``least`` is left."""
    free_a, free_b, out = [True] * len(a), [x is not None for x in b], []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return sorted(out)
        free_a[i : i + k] = free_b[j : j + k] = [False] * k
        out.append((i, j, k))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=14), st.lists(st.integers(0, 3), max_size=20), st.integers(1, 4))
def test_tiles(a, b, least):
    b = [x or None for x in b]
    assert decontam.tiles(a, b, least) == slow_tiles(a, b, least)


def contaminated(docs, items):
    """Pairs of document and item (word lists) of which four fifths are tiled."""
    out = set()
    seeds = {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} for i, x in items.items()}
    for d, text in docs.items():
        words = (text or "").lower().split()
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        have = set(grams)
        for i, item in items.items():
            if not have.isdisjoint(seeds[i]):
                near = sorted({p + o for p, g in enumerate(grams) if g in seeds[i] for o in range(5)})
                text_ = []
                for x, p in enumerate(near):
                    text_ += [None] * (x > 0 and near[x - 1] != p - 1) + [words[p]]
                if 5 * sum(k for *_, k in slow_tiles(item, text_, 5)) >= 4 * len(item):
                    out.add((d, i))
    return out


def test_contamination_by_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    expected = contaminated(docs, items)
    assert expected
    assert {(r.doc_id, r.item_id) for r in QUERIES["op5_decontam"](spark, sf_dir).collect()} == expected


def test_long_monotonous_document(spark):
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, "word " * 60)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "word " * 100), (8, " ".join(f"i{k}" for k in range(50)))], "item_id long, text string")
    start = time.perf_counter()
    got = {tuple(r) for r in decontam.contamination(spark, docs, bench).collect()}
    assert got == {(1, 7, 100, 1, 100)} and time.perf_counter() - start < 60
    start = time.perf_counter()
    assert decontam.tiles([1] * 2000, [1] * 1500 + [None] + [1] * 20_000, 5) == [(0, 1501, 2000)]
    assert sum(k for *_, k in decontam.tiles([x % 7 for x in range(1000)], [x % 7 or None for x in range(20_000)], 5)) == 857 and time.perf_counter() - start < 30


def test_common_phrases_and_hot_seeds(spark, monkeypatch):
    """Items of mostly common phrases, each in very many documents: seeds are dealt, and no item is lost."""
    monkeypatch.setattr(decontam, "EACH", 3)
    monkeypatch.setattr(workspace, "EACH", 3)
    rng = random.Random(1)
    phrases = [" ".join(f"p{k}x{j}" for j in range(8)) for k in range(4)]
    docs = {i: " ".join(rng.choice([*phrases, f"o{i} u{rng.random()}"]) for _ in range(9)) for i in range(60)}
    items = {k: " ".join(rng.choice([*phrases, "rare words here"]) for _ in range(5)).split() for k in range(12)}
    expected = contaminated(docs, items)
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")).collect()}
    assert expected and got == expected


def test_reordered_short_and_odd_items(spark):
    item = [f"t{i}" for i in range(30)]
    mixed = " ".join(["x y", *item[20:30], "z", *item[0:10], "q", *item[10:20]]).upper()
    docs = spark.createDataFrame([(1, mixed, 1), (2, " ".join(item[:20]), 1), (3, None, 1), (4, "", 1), (5, "he said yes indeed to that", 1), (None, mixed, 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, "yes indeed"), (11, "no never")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_tiles) for r in decontam.contamination(spark, docs, bench).collect()}
    assert got == {(1, 7, 3), (5, 10, 1), (None, 7, 3)}
    clean = decontam.keep_clean(spark, docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 2, 3, 4]
    assert decontam.contamination(spark, docs, bench.limit(0)).count() == 0
    assert decontam.contamination(spark, docs.limit(0), bench).count() == 0


def check_packing(docs, got, length=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(docs)
    for d, text in docs.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or s == len(sequences) - 1 and at <= length


def test_packing_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_packing(docs, QUERIES["op10_packing"](spark, sf_dir).collect())


def test_packing_of_odd_texts(spark):
    texts = [None, "", " ", "<|endoftext|> as text", "a" * 60000, "é😀" * 300, " " * 9000, "same words here", "same words here", "x y " * 5000]
    docs = spark.createDataFrame([(i, t, 3, 4) for i, t in enumerate(texts)], "doc_id long, text string, key int, n_tokens int")
    check_packing(dict(enumerate(texts)), packing.pack(spark, docs, length=64).collect(), 64)
    assert packing.pack(spark, docs.limit(0)).count() == 0


def test_hilbert_curve_is_continuous():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert_key(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300))
def test_both_tokenizer_libraries_agree(text):
    e = encoder(default_path())
    assert e.fast and e.ids(text).tolist() == e.slow.encode(text, add_special_tokens=False).ids
