"""Manifest, byte pairs and spelling variants against brute-force versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hostweave.llm import bpe, merkle, variants

from . import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# -- manifest ---------------------------------------------------------------------

def documents(n: int, langs: list, rnd: random.Random) -> list[tuple]:
    return [(i, rnd.choice([None, "", "Same TEXT", f"Text {i} É"]), rnd.choice(langs), rnd.choice([None, "s"]), i)
            for i in rnd.sample(range(10 * n), n)]


def check_manifest(spark, rows):
    got = merkle.manifest_report(table(spark, rows)).collect()
    names = [x.split()[0] for x in DOCS.split(", ")]
    want = plain.manifest([dict(zip(names, r, strict=True)) for r in rows])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return got


@pytest.mark.parametrize("n", [1, 8, 9, 73])
def test_manifest_equals_plain_trees(spark, n):
    check_manifest(spark, documents(n, ["en", "de", "é", None][:n], random.Random(n)))


def test_manifest_of_several_tiers(spark, monkeypatch):
    """Blocks of eight, so that roots climb through several tiers."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rnd = random.Random(5)
    got = check_manifest(spark, documents(140, ["en"] * 9 + [f"l{k}" for k in range(11)] + [None], rnd))
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_repeated_and_null_ids(spark):
    row = (3, "A", "en", "s", 1)
    check_manifest(spark, [row, row, (3, "B", "en", "s", 1), (None, "X", None, None, None), (None, None, "en", None, 2)])


def test_manifest_of_no_rows_and_clashing_columns(spark):
    assert merkle.manifest_report(table(spark, [])).count() == 0
    wide = table(spark, [(1, "A", "en", "s", 1, "x", 7)], DOCS + ", tree string, idx int")
    assert merkle.manifest_report(wide).first().verified is True


def test_appended_witnesses_lead_to_the_root():
    rnd = random.Random(2)
    for total in (1, 2, 8, 9, 64, 65, 200, 512):
        names = [plain.digest(str(rnd.random())) for _ in range(total)]
        block, kept = merkle.Appender(merkle.height(total)), [[] for _ in names]
        for name, witness in zip(names, kept, strict=True):
            block.append(name, witness)
        root = block.finish()
        assert root == plain.tree(names)[0]
        assert all(merkle.folded(name, witness) == root for name, witness in zip(names, kept, strict=True))


# -- byte pairs -------------------------------------------------------------------

def test_tokens_equal_the_library(spark, sf_dir):
    library = Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(1)
    pieces = [*"ab 1é漢🙂\n\t\x1c\x85　'", "'re", "'ll", "  ", "<|endoftext|>", "<|end", "Hello", " world", "́"]
    found = ["".join(rnd.choices(pieces, k=rnd.randrange(30))) for _ in range(400)]
    found += [None, "", "x" * 5_000, "ab" * 3_000, "word " * 4_000]
    found += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    docs = table(spark, list(enumerate(found)), "doc_id long, text string")
    for row in bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect():
        ids = library.encode(found[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == ids
        assert row.decoded.decode() == library.decode(ids, skip_special_tokens=False)


def test_pre_tokens_split_at_every_character_as_the_library():
    library = Tokenizer.from_file(VOCABULARY)
    encoder = bpe.Encoder(bpe.load(VOCABULARY))
    for c in [*range(0xD800), *range(0xE000, 0x110000, 97)]:
        text = f"a {chr(c)}b1 {chr(c)}"
        assert np.frombuffer(encoder(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_digests_of_repeated_null_and_no_rows(spark):
    docs = table(spark, [(1, "Aa", 1), (1, "Aa", 2), (None, None, 3)], "doc_id long, text string, ids int")
    rows = bpe.round_trip(docs, VOCABULARY).collect()
    assert len(rows) == 3 and len({tuple(r) for r in rows}) == 2
    empty = next(r for r in rows if r.doc_id is None)
    assert (empty.n_tokens, empty.ids_sha256, empty.decoded_sha256) == (0, plain.digest(), plain.digest())
    assert bpe.round_trip(docs.where("false"), VOCABULARY).count() == 0


def test_merges_are_lowest_rank_then_leftmost():
    rnd = random.Random(4)
    for _ in range(300):
        merges = {}
        for rank in range(rnd.randrange(1, 12)):
            a, b = rnd.randrange(3 + rank), rnd.randrange(3 + rank)
            merges.setdefault(a * 50 + b, (rank, 3 + rank))
        start = [rnd.randrange(3) for _ in range(rnd.randrange(1, 25))]
        plainly = start[:]
        while True:
            ranked = [(merges[a * 50 + b][0], i) for i, (a, b) in enumerate(zip(plainly, plainly[1:], strict=False)) if a * 50 + b in merges]
            if not ranked:
                break
            i = min(ranked)[1]
            plainly[i:i + 2] = [merges[plainly[i] * 50 + plainly[i + 1]][1]]
        assert bpe.merged(start, merges, 50) == plainly


# -- spelling variants --------------------------------------------------------------

@pytest.mark.parametrize(("letters", "n", "longest", "group"), [("ab", 250, 9, 3), ("abcé", 300, 7, 2_000), ("ab", 120, 12, 2)])
def test_variants_equal_all_pairs(spark, letters, n, longest, group):
    rnd = random.Random(n)
    words = {"".join(rnd.choices(letters, k=rnd.randrange(1, longest))): rnd.choice([1, 5, 25, 125, 130]) for _ in range(n)}
    got = variants.variant_forms(table(spark, list(words.items()), "word string, n long"), group=group).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain.variants(words)))


def test_each_pair_is_linked_once(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaaab", "abaaaa", "aabaaa", "abaaaaa"]
    pairs = [(r.word, r.near) for r in variants.links(table(spark, [(w, 1) for w in words], "word string, n long"), 1).collect()]
    assert len(pairs) == len(set(pairs))
    near = {w: k for w, *_, k, _ in plain.variants(dict.fromkeys(words, 1))}
    assert Counter(w for w, _ in pairs) == {w: k for w, k in near.items() if k}


def test_acceptor_is_minimal():
    found = variants.Acceptor(["abxyz", "acxyz", "bxyz"])
    assert len(found.arcs) == 6
    assert sorted(variants.replaced(variants.Acceptor(["abc", "abd", "xbc"]))) == [("abc", "abd"), ("abc", "xbc")]


def test_vocabulary_thins_runs(spark):
    rows = [(i, "Éclair étoile-NAÏVETÉ wordsÿ short") for i in range(400)] + [(None, "wordsÿ"), (7, None), (8, "")]
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            code = zlib.crc32(f"{i}:{word}".encode()) if i is not None else 1
            if code % 199 == 0:
                word = word[:code % len(word)] + word[code % len(word) + 1:]
            want[word] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = variants.vocabulary(table(spark, rows, "doc_id long, text string"))
    assert {r.word: r.n for r in got.collect()} == want
    wide = table(spark, [r + (0, 0) for r in rows], "doc_id long, text string, word int, n int")
    assert variants.spelling_variants(wide).count() == len(want)
    assert variants.spelling_variants(wide.where("false")).count() == 0
