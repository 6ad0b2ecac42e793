"""Brute-force versions that the training-data tests compare with."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256


def words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text: str | None) -> set[tuple]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def groups(docs: list[tuple]) -> dict:
    """Smallest reachable id by id, over links at a similarity of 0.75."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def repeated(docs: list[tuple], least: int) -> tuple[dict, dict]:
    """Word places in any repeated run of ``least`` words, and those in a later copy."""
    where = defaultdict(list)
    for i, text in docs:
        w = words(text)
        for j in range(len(w) - least + 1):
            where[tuple(w[j:j + least])].append((i, j))
    any_, later = defaultdict(set), defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for i, j in places:
                any_[i].update(range(j, j + least))
                if (i, j) != min(places):
                    later[i].update(range(j, j + least))
    return any_, later


def counts(text: str | None) -> tuple:
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(runs)
    covered = set()
    for i, run in enumerate(runs):
        if often[run] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def subsequence(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """Root over ``nodes``, eight at a time, and each one's places and siblings."""
    steps, inside = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, merged = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a:a + 8]
            for k in range(len(run)):
                for i in inside[a + k]:
                    steps[i].append((k, run[:k] + run[k + 1:]))
            above.append(digest(*run))
            merged.append([i for own in inside[a:a + 8] for i in own])
        nodes, inside = above, merged
    return nodes[0], steps


def manifest(docs: list[dict]) -> list[tuple]:
    """doc_id, leaf, subroot, root, proof, folded root and verdict of every document."""
    def leaf(d, text):
        values = (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    by_lang = defaultdict(list)
    for d in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), d["text"]) if d["text"] is not None else None
        odd = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0
        by_lang[d["lang"]].append((d["doc_id"], leaf(d, d["text"]), leaf(d, low) if odd else ""))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for rows in by_lang.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    trees = {x: tree([r[1] for r in by_lang[x]]) for x in langs}
    if not langs:
        return []
    root, upper = tree([trees[x][0] for x in langs])
    out = []
    for x, rest in zip(langs, upper, strict=True):
        for (doc_id, own, claim), steps in zip(by_lang[x], trees[x][1], strict=True):
            top, steps = claim or own, steps + rest
            for place, others in steps:
                top = digest(*others[:place], top, *others[place:])
            proof = digest(*(o for _, others in steps for o in others))
            out.append((doc_id, own, trees[x][0], root, proof, top, top == root))
    return out


def variants(counts: dict[str, int]) -> list[tuple]:
    """word, form, root, n, n_near and form_n by comparing all pairs of words."""
    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    close = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 5 * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(close[w]), counts.get(form.get(w))))
    return out
