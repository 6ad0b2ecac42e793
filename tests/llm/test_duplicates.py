from __future__ import annotations

import random

import numpy as np
import pytest

from hostweave.llm import graph, near, suffix

from . import plain

DOCS = "doc_id long, text string"


def made(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)

    def fresh(k: int) -> list[str]:
        return [rng.choice("abcdefg") + str(rng.randrange(400)) for _ in range(k)]

    shared = [fresh(k) for k in (55, 70, 120)]
    docs: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        w = fresh(rng.choice([0, 1, 4, 5, 6, 30, 90, 160]))
        if kind < 0.35 and docs:
            w = (rng.choice(docs)[1] or "").split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = "X" + str(rng.randrange(99))
        elif kind < 0.6:
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(shared) + w[at:]
        docs.append((i * 3 % n if n % 3 else i, " ".join(w).title() if kind > 0.9 else " \t".join(w)))
    docs.append((n + 1, None))
    docs.append((n + 2, "same " * 200))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_equal_brute_force(spark, seed):
    docs = made(seed, 160)
    got = {r.doc_id: r for r in near.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    want = plain.groups(docs)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert all(got[i].n_shingles == len(plain.shingles(t)) for i, t in docs)


def test_near_leftover_join_finds_links_the_hubs_miss(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [base]
    for k in range(30):  # each links with the next, hardly any with the first
        w = list(chain[-1])
        w[(7 * k) % 60] = f"n{k}"
        chain.append(w)
    docs = [(i, " ".join(w)) for i, w in enumerate(chain)]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == plain.groups(docs)


def test_near_nulls_repeats_clashing_columns_and_empty(spark):
    rows = [(1, "a b c d e f", 9, "x"), (1, "a b c d e f", 9, "x"), (None, "a b c d e f", 9, "x"), (2, None, 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept long, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (None, 2, None, True)]
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_superminhash_estimates_similarity_and_stops_early():
    rng = np.random.default_rng(3)
    both, left, right = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (600, 200, 200))
    sets = [np.unique(np.concatenate([both, left])), np.unique(np.concatenate([both, right])), left[:1]]
    out = near.superminhash(sets, 128)
    assert abs((out[0] == out[1]).mean() - 0.6) < 0.12
    assert (out < np.iinfo(np.uint64).max).all()
    assert len(set((out[2] >> np.uint64(32)).tolist())) == 128  # one rank per place


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long"), "t").collect()}
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    assert all(root(x) == c for x, c in got.items())
    assert {x for u, v in links if u != v for x in (u, v)} == set(got)


@pytest.mark.parametrize("seed", [1, 5])
def test_marked_words_equal_brute_force(spark, seed):
    docs = made(seed, 90)
    got = {r.doc_id: r for r in suffix.remove_repeats(spark.createDataFrame(docs, DOCS).repartition(4)).collect()}
    any_, later = plain.repeated(docs, suffix.LEAST)
    for i, text in docs:
        marked = {x for s in got[i].spans for x in range(s["first"], s["last"])}
        assert marked <= any_[i] and later[i] <= marked
        assert plain.words(got[i].text) == [w for j, w in enumerate(plain.words(text)) if j not in marked]
        assert got[i].removed_words == len(marked) and got[i].n_words == len(plain.words(text))


def test_every_removed_passage_stays_somewhere(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    docs = [(i, f"a{i} b{i} {passage} c{i}") for i in range(40)]
    got = {r.doc_id: r.text for r in suffix.remove_repeats(spark.createDataFrame(docs, DOCS)).collect()}
    assert [i for i in got if "p35" in got[i]] == [0]
    assert got[7] == "a7 b7 c7"


def test_repeats_edge_rows(spark):
    long = " ".join(f"q{i}" for i in range(200))
    rows = [(1, "a b", 5), (1, long, 5), (2, "z " + long, 5), (2, "z " + long, 5), (3, None, 5), (None, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    got = [(r.doc_id, r.n_words, r.removed_words, r.text) for r in suffix.remove_repeats(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 2, 0, "a b"), (1, 200, 0, long), (2, 201, 200, "z"), (2, 201, 200, "z"), (3, 0, 0, None),
        (None, 200, 0, long)], key=str)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def same_as_brute_force(spark, docs):
    got = {r.doc_id: r for r in suffix.remove_repeats(spark.createDataFrame(docs, DOCS)).collect()}
    _, later = plain.repeated(docs, suffix.LEAST)
    assert any(later.values())
    for i, _ in docs:
        assert {x for s in got[i].spans for x in range(s["first"], s["last"])} == later[i]


@pytest.mark.parametrize("parts", [4, 60])
def test_partners_behind_a_common_passage_are_found_across_partitions(spark, parts):
    rng = random.Random(12)
    notice = " ".join(f"n{i}" for i in range(35))
    docs = []
    for i in rng.sample(range(400), 400):
        before = " ".join(f"b{i // 2}x{k}" for k in range(15))  # shared by two documents
        docs.append((i, f"a{i} {before} {notice} " + " ".join(f"c{rng.randrange(10**6)}" for _ in range(40))))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same_as_brute_force(spark, docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_partner_among_many_nearly_long_ones_is_found(spark):
    rng = random.Random(13)
    docs: list[tuple] = []

    def add(words):
        docs.append((len(docs), f"o{len(docs)}a {' '.join(words)} o{len(docs)}b"))

    for g in range(5):
        line = [f"g{g}w{k}" for k in range(75)]
        for k in range(150):
            if k == 75:
                add(line[12:62])  # the only one that shares 50 words with the whole line
            size = rng.randrange(45, 50)
            at = rng.randrange(76 - size)
            add(line[at:at + size])
        add(line)
    same_as_brute_force(spark, docs)


def test_an_id_over_several_texts_is_linked_by_each(spark):
    rng = random.Random(3)
    a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3))
    rows = [(1, a), (1, b), (2, [*a[:58], "x"]), (3, [*b[:58], "y"]), (0, c), (7, c), (7, a), (9, ["alone"] * 9)]
    rows = [(i, " ".join(t)) for i, t in rows]
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r.doc_id: r.component_id for r in near.near_duplicates(df).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 0, 7: 0, 9: 9}
