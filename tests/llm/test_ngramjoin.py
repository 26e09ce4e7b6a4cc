from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest

from lodestone.llm import ngramjoin
from lodestone.llm.components import components
from lodestone.llm.ngramjoin import all_links, ngram_join
from lodestone.llm.wordhash import NOT_SPACE, hash_words, string_buffers
from lodestone.scratch import cut, spread_join


def brute(rows, k, num, den):
    """Shingles as tuples, all pairs, union by repeated relabelling."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    comp = {i: i for i in sets if i is not None}
    links = [(a, b) for a in comp for b in comp if a < b for x in sets[a] for y in sets[b] if x and y and den * len(x & y) >= num * len(x | y)]
    for _ in comp:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {(i, len(s), comp.get(i)) for i in sets for s in sets[i]}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = rng.choices(words, k=30)
    out = []
    for _ in range(n):
        base = rng.choices(words, k=rng.choice([0, 1, 3, 4, 5, 7, 9, 12, 20, 45, 120]))
        if rng.random() < 0.3:
            base = base[: len(base) // 8] + passage
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(copy + rng.choices(words, k=rng.choice([0, 0, 1])))
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 4, 85, 100), (3, 2, 60, 100)])
def test_components_are_those_of_all_pairs(docs, seed, k, num, den):
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    found, links = ngram_join(docs([t for _, t in rows], [i for i, _ in rows]), k=k, num=num, den=den)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, k, num, den)
    assert links.count() > 0


def test_a_group_of_near_copies_does_not_multiply(docs):
    rng = random.Random(4)
    base = [f"v{i}" for i in range(100)]
    texts = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(100)] = f"x{i}"
        texts.append(" ".join(copy))
    found, links = ngram_join(docs(texts), k=4, num=85, den=100)
    assert {r.component_id for r in found.collect()} == {0}
    assert links.count() < 150 * 149 // 4


def test_edges_of_the_contract(docs):
    rows = [(5, None), (6, ""), (7, "  \t "), (8, "one two"), (9, "ONE\ntwo"), (9, "one two three four five"), (10, "one two three four five"), (None, "one two"), (11, "Ä b c d"), (12, "ä b c d")]
    found, _ = ngram_join(docs([t for _, t in rows], [i for i, _ in rows]), k=4, num=85, den=100)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (9, 2, 8), (10, 2, 8), (None, 1, None), (11, 1, 11), (12, 1, 12)], key=str)
    assert ngram_join(docs([]), k=4, num=85, den=100)[0].count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_all_links_and_joins_by_shuffle(docs, monkeypatch, shuffled):
    """Every pair that links; with nothing broadcast and every key split, the same."""
    if shuffled:
        monkeypatch.setattr("lodestone.scratch.BROADCAST_BYTES", -1)
        monkeypatch.setattr("lodestone.scratch.SPREAD_ROWS", 3)
    texts = corpus(7, 60)
    sets = [{tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if (w := t.split()) else set() for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    reps = sorted(i for s, i in first.items() if s)
    want = {(a, b, len(sets[a] & sets[b])) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(want) > 20
    assert {tuple(r) for r in all_links(docs(texts), k=4).collect()} == want
    found, _ = ngram_join(docs(texts), k=4)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()} == brute(list(enumerate(texts)), 4, 80, 100)


def test_repeated_rows_of_an_id(docs):
    texts = ["a b c d e f"] * 40 + ["a b c d e f g"] * 40
    found, links = ngram_join(docs(texts, [1] * 40 + [2] * 40), k=2)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(1, 1)] * 40 + [(2, 1)] * 40
    assert [(r.a, r.b, r.overlap) for r in links.collect()] == [(1, 2, 5)]


def test_long_words_do_not_collide():
    """Polynomials modulo a power of two take the same value on a Thue-Morse word and its complement."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    import pyarrow as pa

    hashes, first = hash_words(*string_buffers(pa.array([one, two, one.upper() + " x", "x " + one])), NOT_SPACE)
    assert list(first) == [0, 1, 2, 4, 6]
    assert hashes[0] == hashes[2] == hashes[5] != hashes[1]
    assert hashes[3] == hashes[4]


def test_sizes_stay_those_of_the_files(spark):
    t = cut(spark.range(300).selectExpr("id", "id + 1 as n"))
    for _ in range(10):
        t = cut(t.alias("a").join(t.select("id").alias("b"), "id").select("id", "n"))
    assert int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, monkeypatch, how):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(200)], "k long, v long")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (500, "w")], "k long, w string")
    want = sorted(map(tuple, left.join(right, ["k"], how).collect()))
    monkeypatch.setattr("lodestone.scratch.BROADCAST_BYTES", -1)
    monkeypatch.setattr("lodestone.scratch.SPREAD_ROWS", 10)
    assert sorted(map(tuple, spread_join(left, right, ["k"], how).collect())) == want


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(table).collect()}
    for few in (0, 60):  # all by rounds, and rounds until one task takes the rest
        assert got == {r.id: r.component for r in components(table, one_task=few).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k not in alone}


def test_counting_shingles_holds_two_copies():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 300_000, 1000, dtype=np.uint64) for _ in range(500)]
    value, times = np.unique(np.concatenate(parts), return_counts=True)
    tracemalloc.start()
    got = ngramjoin.thrice(held := list(parts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not held and np.array_equal(got[0], value[times >= 3]) and np.array_equal(got[1], times[times >= 3])
    assert peak < 2.5 * sum(x.nbytes for x in parts)
    assert [len(x) for x in ngramjoin.thrice([np.array([1, 1], np.uint64)])] == [0, 0]
