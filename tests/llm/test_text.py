from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from hostweave.llm import chat, common, kneser, language, ordered, pages

from . import plain


def test_words_are_found_and_hashed_alike():
    texts = ["Ab  c\n\tDé", "", " ", "ab C dé", "x" * 5000 + " y", None, "\x0b\x0cz\xa0z"]
    column = pa.array([t.encode() if t is not None else None for t in texts], pa.binary())
    for part in (column, column.slice(2, 4)):
        hashes, first, starts, ends = common.words(part)
        found = [plain.words(t.decode() if t is not None else "") for t in part.to_pylist()]
        assert [b - a for a, b in zip(first[:-1], first[1:], strict=True)] == [len(f) for f in found]
        flat = [w for f in found for w in f]
        same = {}
        for w, h in zip(flat, hashes.tolist(), strict=True):
            assert same.setdefault(w, h) == h
        assert len(set(same.values())) == len(same)
        assert (ends - starts).tolist() == [len(w.encode()) for w in flat]


def kneser_by_hand(docs: list[tuple]):
    count, pairs = Counter(), Counter()
    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 10:
            tokens = [*plain.words(text), None]
            count.update(tokens)
            pairs.update(zip(["<s>", *tokens], tokens, strict=False))
    follow = Counter(b for _, b in pairs)
    total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), n in pairs.items():
        total[a] += n
        kinds[a][min(n, 3) - 1] += 1

    def cuts(values):
        return kneser.discounts(*(sum(1 for v in values if v == k) for k in (1, 2, 3, 4)))

    d2, d1, types = cuts(pairs.values()), cuts(follow.values()), sum(follow.values())
    spread = sum(d * sum(1 for v in follow.values() if min(v, 3) == k) for k, d in enumerate(d1, 1)) / types

    def cut(n, d):
        return n - (0, *d)[min(n, 3)]

    def lower(w):
        return cut(follow[w], d1) / types + spread / (len(count) + 1)

    def chance(a, w):
        if not total[a]:
            return lower(w)
        return (cut(pairs[a, w], d2) + sum(x * y for x, y in zip(d2, kinds[a], strict=True)) * lower(w)) / total[a]
    return count, chance


@pytest.mark.parametrize("cell", [100, 10**9])
def test_scores_equal_a_model_by_hand(spark, monkeypatch, cell):
    monkeypatch.setattr(kneser, "CELL_BYTES", cell)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdeFG") * rng.randrange(1, 3) for _ in range(rng.randrange(30)))) for i in range(80)]
    docs += [(500, None), (501, "never seen words")]
    got = {r.doc_id: r for r in kneser.score_held_out(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    count, chance = kneser_by_hand(docs)
    n, v = sum(count.values()), len(count)
    assert abs(sum(chance("a", w) for w in count) + chance("a", "zzz") - 1) < 1e-9
    for i, text in docs:
        tokens = [*plain.words(text), None]
        want = sum(math.log10(chance(a, w)) for a, w in zip(["<s>", *tokens], tokens, strict=False))
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[i]
        assert r.score == pytest.approx(want) and r.base_score == pytest.approx(base)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_scores_without_training_rows(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = kneser.score_held_out(df).first()
    assert row.held_out and row.n_known == 0 and math.isfinite(row.score)
    assert kneser.score_held_out(df.limit(0)).count() == 0


def test_chat_round_trip_of_hostile_texts(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "\\", "\\\\<|", "<|>", "<<SYS>> <</SYS>>", "", None,
               "a\nb\\n", "[[INST]", "<<|", "|>|>"]
    rows = [(7, i, ["user", "assistant", "sys\ntem<|", None][i % 4], t) for i, t in enumerate(hostile)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "part", chat.F.lit(0))
    pieces = chat.formatted_turns(turns).orderBy("turn").collect()
    for (_, _, role, text), r in zip(rows, pieces, strict=True):
        assert chat.read_back(r.piece) == [(role or "", text or "")]
        for control in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert control not in r.piece
        assert r.piece.count("<|") == 2 and (r.loss_length > 0) <= (role == "assistant")
    digest = chat.digests(chat.formatted_turns(turns)).first()
    said = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in rows)
    loss = "".join(text or "" for _, _, role, text in rows if role == "assistant")
    assert digest.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (digest.loss_chars, digest.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_layouts_become_the_same_turns(spark):
    rows = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"completion":"a","prompt":"q"}', '{"response":"a","prompt":"q"}', '{"instruction":"q","output":"a"}',
        '{"instruction":"q","input":"","output":"a"}', '{"other":1}', "no json", None,
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, payload string")
    got: dict[int, list] = defaultdict(list)
    for r in sorted(chat.canonical_turns(df).collect(), key=lambda r: (r.id, r.part or 0)):
        got[r.id].append((r.role, r.text))
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(6))
    assert all(got[i] == [(None, None)] for i in (6, 7, 8))
    both = spark.createDataFrame([(1, {"prompt": "q", "response": "a"})], "id long, payload struct<prompt:string,response:string>")
    assert [(r.role, r.text) for r in chat.canonical_turns(both).collect()] == [("user", "q"), ("assistant", "a")]


def phrases_by_hand(train: str, text: str) -> int:
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in train:
            size += 1
        at += size
        n += 1
    return n


def test_cross_parsing_counts_phrases():
    rng = random.Random(6)
    train = "".join(rng.choice("abcd ") for _ in range(400))
    model = language.Classifier({"x": train})
    texts = ["".join(rng.choice("abcd e") for _ in range(n)) for n in (1, 5, 100, 512)] + [""]
    got = model.phrases(texts)[:, 0] / math.log2(model.automata[0].size + 2)
    assert got.round().tolist() == [phrases_by_hand(train, t) for t in texts]


def test_letters_of_all_scripts_are_kept():
    rng = random.Random(14)
    scripts = {n: "".join(chr(first + k) for k in range(size)) + " " for n, first, size in (
        ("ar", 0x627, 28), ("el", 0x3B1, 25), ("la", 0x61, 26), ("ru", 0x430, 32), ("zh", 0x4E00, 900))}
    trains = {n: "".join(rng.choice(s) for _ in range(4000 if n != "el" else 500)) for n, s in scripts.items()}
    model = language.Classifier(trains)
    texts = [trains[n][200:400] for n in sorted(trains)] + ["".join(rng.choice(s) for _ in range(200)) for s in scripts.values()]
    cost = model.phrases(texts)
    assert cost[:5].argmin(axis=1).tolist() == [0, 1, 2, 3, 4]
    for k, n in enumerate(model.languages):
        got = cost[:, k] / math.log2(model.automata[k].size + 2)
        assert got.round().tolist() == [phrases_by_hand(trains[n], t) for t in texts]


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    words = {"aa": "the of and to in that was".split(), "bb": "der die und nicht für über".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 1500))), lang)
            for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "12 345 !!", "bb"), (902, "Über DER die", None), (None, "the of", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", chat.F.lit(1))
    got = {r.doc_id: r for r in language.identify_held_out(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[4].held_out == (zlib.crc32(b"4") % 4 == 2)
    assert {r.lang_pred for r in language.identify_held_out(df.withColumn("lang", chat.F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify_held_out(df.limit(0)).count() == 0


def test_order_minhash_follows_edits_and_order():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    same = ordered.sketch(ordered.code_points(text))
    last = 1.1
    for rate in (0.0, 0.005, 0.05, 0.4):
        changed = "".join(rng.choice("xyz") if rng.random() < rate else c for c in text)
        now = ordered.likeness(same, ordered.sketch(ordered.code_points(changed)))
        assert now < last and (rate or now == 1.0)
        last = now
    parts = [text[i:i + 400] for i in range(0, 4000, 400)]
    moved = ordered.likeness(same, ordered.sketch(ordered.code_points("".join(reversed(parts)))))
    assert moved < 0.9  # nearly all k-mers stay, their order does not
    assert ordered.likeness(ordered.sketch(ordered.code_points("")), ordered.sketch(ordered.code_points(""))) == 1.0


def test_order_minhash_keeps_its_ranks_when_a_text_grows():
    rng = random.Random(11)
    for n in range(1020, 1041):
        text = "".join(rng.choice("abcdefghij ") for _ in range(n))
        longer = text + "".join(rng.choice("abcdefghij ") for _ in range(8))
        a, b = (ordered.sketch(ordered.code_points(t)) for t in (text, longer))
        assert ordered.likeness(a, b) > 0.9


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_each_text_is_compared_with_the_next(spark, parts):
    rng = random.Random(9)
    docs = [(i, "".join(rng.choice("añ漢𝄞b c") for _ in range(rng.randrange(90)))) for i in rng.sample(range(500), 30)]
    docs.append((501, None))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", ordered.F.lit("x"))
        got = {r.doc_id: r for r in ordered.compared(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(docs, reverse=True)
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        changed = ordered.edited(text, following)
        mine, other, after = (ordered.sketch(ordered.code_points(t)) for t in (text, changed, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (ordered.as_text(mine), ordered.as_text(other))
        assert (r.near_edited, r.near_next) == (ordered.likeness(mine, other), ordered.likeness(mine, after))


def test_compared_edge_tables(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    row = ordered.compared(df).first()
    assert row.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and row.near_next == 1.0
    assert ordered.compared(df.limit(0)).count() == 0
    assert ordered.compared(df.union(df)).count() == 2


PAGE = ("<html><head><title>t</title><script>var a='</p>';</script></head><body>{top}{body}{end}</body></html>")


def test_pages_lose_shared_lines_and_furniture(spark):
    top = "<div>Our Site</div><div>Home | News</div>"
    end = "<div>Terms apply</div><div class='cookie-notice'>We use cookies</div><!-- x -->"
    rows = [(i, f"http://www.a.com/news/{i}", PAGE.format(
        top=top, end=end, body=f"<p>Story {i} &amp; more<p>Body&nbsp;{i}<br>goes <b>on</b>")) for i in range(9)]
    rows += [
        (20, "http://b.com/x", "<body><nav>menu</nav><article><header><h1>Title</h1></header><p>One</p>"
         "<aside>see</aside><section class='comments'>bad</section></article><footer>f</footer></body>"),
        (21, "http://b.com/y", "<body><nav>menu</nav><article><h1>Title</h1><p>Two</p><form>f</form></article></body>"),
        (30, None, "<p>Alone</p>"), (31, "http://c.com/", None), (32, "http://d.com/", "<p>unclosed <a href='x"),
        (40, "http://e.com/1", "<p>Copy</p>"), (41, "http://e.com/2", "<p>Copy</p>"), (41, "http://e.com/2", "<p>Copy</p>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", pages.F.lit(3))
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert all(got[i] == f"Story {i} & more\n\nBody {i} goes on" for i in range(9))
    assert got[20] == "Title\n\nOne" and got[21] == "Title\n\nTwo"
    assert (got[30], got[31], got[40], got[41]) == ("Alone", "", "Copy", "Copy")
    assert pages.main_text(df).count() == len(rows) and pages.main_text(df.limit(0)).count() == 0


def test_page_results_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h.com/{rng.randrange(30)}", "".join(f"<p>l{rng.randrange(12)}</p>" for _ in range(rng.randrange(9))))
            for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for parts in (1, 7, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        seen.append(sorted((r.page_id, r.text) for r in pages.main_text(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2]


def test_alignment_is_longest():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(15))] for _ in range(2))
        places = sorted(pages.aligned(a, b))
        assert len(places) == plain.subsequence(a, b)
        pages.TABLE_BITS, usual = 6, pages.TABLE_BITS
        try:
            halved = sorted(pages.aligned(a, b))
        finally:
            pages.TABLE_BITS = usual
        assert len(halved) == len(places)
        left = iter(b)
        assert all(a[i] in left for i in halved)
        rest = iter(b)
        assert all(a[i] in rest for i in places)


def test_long_repetitive_pages_align_in_little_memory():
    rng = random.Random(1)
    a, b = ([rng.randrange(40) for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    places = sorted(pages.aligned(a, b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    rest = iter(b)
    assert all(a[i] in rest for i in places) and len(places) == pages._lengths(a, b)[-1]


@pytest.mark.parametrize("page,text", [
    ("<article class='post category-advertising'><p>T</p></article>", "T"),
    ("<article class='sponsored'><p>T</p></article>", "T"),
    ("<article class='sponsored'>ad</article><article>T</article>", "T"),
    ("<div class='layout no-sidebar'><article>T</article></div>", "T"),
    ("<div class='sidebar-right'><article>T</article></div>", "T"),
    ("<form id='aspnetForm'><div>menu</div><main>T</main></form>", "T"),
    ("<article class='post comments-open'>T</article>", "T"),
    ("<div id='content' class='has-widgets'>T</div>", "T"),
    ("<article><h2 id='login-flow'>Log in</h2><section id='related-work'>T</section></article>", "Log in\n\nT"),
    ("<article>T<div id='related-posts'>r</div><div id='comments'>c</div></article>", "T"),
    ("<article>T</article><section id='comments'><article class='comment-body'>c</article></section>", "T"),
    ("<div class='text'>T</div><div class='comments'><article>c</article></div>", "T"),
    ("<article>T<article class='comment'>c</article><form>f</form></article>", "T"),
    ("<div class='sidebar'>s</div><form>f</form><div class='text'>T</div>", "T"),
    ("<div class='cookie-notice'>c</div><nav><article>n</article></nav>", ""),
])
def test_furniture_words_never_take_an_article(page, text):
    assert "\n\n".join(t for t, _ in pages.text_lines(page)) == text


def test_near_copies_keep_their_text(spark):
    body = [f"<p>Paragraph {i} tells something about the subject number {i} in many plain words.</p>" for i in range(20)]
    other = [*body[:7], "<p>One line was revised here and says something else than it did before.</p>", *body[8:]]
    rows = [(1, "http://a.com/x", "".join(body)), (2, "http://a.com/x?print", "".join(other)),
            (3, "http://b.com/1", "<p>Home</p><p>About us</p><p>Imprint</p><p>t</p>"),
            (4, "http://b.com/2", "<p>Home</p><p>About us</p><p>Imprint</p><p>u</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert len(got[1].split("\n\n")) == len(got[2].split("\n\n")) == 20
    assert (got[3], got[4]) == ("t", "u")


def test_pages_against_a_plain_version(spark):
    rng = random.Random(9)
    rows = [(i, f"http://h{rng.randrange(3)}.com/{rng.randrange(40)}",
             "".join(f"<p>l{rng.randrange(25)}</p>" for _ in range(rng.randrange(9)))) for i in range(80)]
    lines = {i: [t for t, _ in pages.text_lines(page)] for i, _, page in rows}
    order = sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/")[3], r[1], r[0]))
    expected = {}
    for k, (i, url, _) in enumerate(order):
        gone: set[int] = set()
        for other in order[max(k - 1, 0):k] + order[k + 1:k + 2]:
            if other[1].split("/")[2] == url.split("/")[2]:
                shared = pages._longest(lines[i], lines[other[0]])
                assert len(shared) == plain.subsequence(lines[i], lines[other[0]])
                shared = pages.aligned(lines[i], lines[other[0]])
                if len(shared) < len(lines[i]):
                    gone |= shared
        expected[i] = "\n\n".join(t for j, t in enumerate(lines[i]) if j not in gone)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.main_text(df).collect()} == expected
