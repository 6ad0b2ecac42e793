"""Byte-level BPE encoding with a segment tree over adjacent pair ranks.

A pre-token is a row of byte symbols.  The leaves of the tree hold, for each pair
of adjacent symbols, its merge rank and place; every inner node holds the least of
its two children.  The root therefore names the leftmost pair of lowest rank.  A
merge touches three leaves and their ancestors.  It ends when the root holds no
mergeable pair.  A pre-token of n bytes costs n log n, also if it is very long.

The vocabulary is read on the driver from a file (a parameter) and broadcast; its
size is that of a vocabulary and is checked.
"""

from __future__ import annotations

import json
import os
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Batches, bounded_batches, lists, texts

#: Fixed value: the pattern by which byte-level pre-tokenizers of this kind split text
#: (L letters, N numbers, S white space).
PRE_TOKENS = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
CLASSES = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\p{White_Space}"}
VOCABULARY_BYTES = 64 << 20
CACHED, CACHED_CHARS = 1 << 18, 64
BASIC = 1 << 16
NONE = 1 << 62

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in vocabulary files: itself
    if it is a visible Latin-1 character, else the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Vocabulary:
    """What a worker needs of a vocabulary file."""

    def __init__(self, data: dict):
        model, letters = data["model"], byte_letters()
        plain = model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        split = data["pre_tokenizer"]
        if not plain or data["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] \
                or not split["use_regex"] or data["decoder"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in data["added_tokens"])]) + 1
        self.first = [ids[c] for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left] * self.size + ids[right]] = rank, ids[left + right]
        byte = {c: b for b, c in enumerate(letters)}
        names = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
        self.bytes = [b""] * self.size
        for i, token in names.items():
            known = all(c in byte for c in token)
            self.bytes[i] = bytes(byte[c] for c in token) if known else token.encode()
        added = data["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not supported")
        self.added = {t["content"]: t["id"] for t in added}


def merged(symbols: list[int], merges: dict[int, tuple[int, int]], size: int) -> list[int]:
    """Merge the leftmost pair of lowest rank until no pair can be merged."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = symbols[:]
    width = 1 << (n - 2).bit_length()
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        if found := merges.get(symbols[i] * size + symbols[i + 1]):
            tree[width + i] = found[0] * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def update(i: int, rank: int) -> None:
        i += width
        tree[i] = rank
        while i > 1:
            least = min(tree[i], tree[i ^ 1])
            i >>= 1
            if tree[i] == least:
                return
            tree[i] = least

    while (top := tree[1] if width > 1 else tree[width]) != NONE:
        i = top % width
        j = after[i]
        symbols[i] = merges[symbols[i] * size + symbols[j]][1]
        symbols[j] = -1
        after[i] = k = after[j]
        if j < n - 1:
            update(j, NONE)
        if k < n:
            before[k] = i
            found = merges.get(symbols[i] * size + symbols[k])
            update(i, found[0] * width + i if found else NONE)
        else:
            update(i, NONE)
        if (h := before[i]) >= 0:
            found = merges.get(symbols[h] * size + symbols[i])
            update(h, found[0] * width + h if found else NONE)
    return [s for s in symbols if s >= 0]


def _ranges(pattern: str) -> str:
    """A character class of the standard library's ``re`` for the characters below
    U+10000 that match ``pattern``."""
    hits = [m.start() for m in regex.finditer(pattern, "".join(map(chr, range(BASIC))))]
    starts = [c for k, c in enumerate(hits) if not k or hits[k - 1] != c - 1]
    ends = [c for k, c in enumerate(hits) if k + 1 == len(hits) or hits[k + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def _pattern(classes: dict[str, str]) -> str:
    return "".join(classes.get(c, c) if c.isupper() else c for c in PRE_TOKENS)


class _Known(dict):
    """Ids of pre-tokens seen before, as bytes.

    Long pre-tokens are not kept.  A full table becomes ``older``; what is met again
    moves back, so frequent pre-tokens stay and memory is bounded.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, token: str) -> bytes:
        out = self.older.get(token)
        if out is None:
            v = self.vocabulary
            ids = merged([v.first[b] for b in token.encode()], v.merges, v.size)
            out = np.array(ids, "<u4").tobytes()
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[token] = out
        return out


class Encoder:
    """Encodes texts; strings of added tokens become these tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, _Known(vocabulary)
        self.basic = re.compile(_pattern({k: _ranges(c) for k, c in CLASSES.items()})).findall
        self.any = regex.compile(_pattern(CLASSES)).findall
        names = sorted(map(regex.escape, vocabulary.added), key=len, reverse=True)
        self.split = regex.compile(f"({'|'.join(names)})").split if names else lambda text: [text]

    def pieces(self, text: str) -> list[str]:
        basic = text.isascii() or ord(max(text)) < BASIC
        return (self.basic if basic else self.any)(text)

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.split(text)):
            if k % 2:
                out.append(np.array([self.vocabulary.added[part]], "<u4").tobytes())
            else:
                out.extend(map(self.known.__getitem__, self.pieces(part)))
        return b"".join(out)


def load(path: str) -> Vocabulary:
    """Read a vocabulary file on the driver."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary should be")
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids``, the tokens of every whole text (null: empty, no tokens).

    ``path`` names a byte-level BPE vocabulary in the tokenizers library's format.
    Rows are encoded one by one: repeated rows and ids stay, other columns are not read.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Batches) -> Batches:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            found = [encoder(t.decode("utf-8", "replace")) for t in batch["text"].to_pylist()]
            flat = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
            yield pa.record_batch({
                "doc_id": batch["doc_id"].cast(pa.int64()),
                "ids": lists(flat, np.array([len(x) // 4 for x in found], np.int32))})

    return texts(docs, "doc_id").mapInArrow(run, ENCODED)


def _decoded(batch: pa.RecordBatch, names: list[bytes]):
    """Ids of each row, and the bytes they stand for, made valid UTF-8."""
    ids = batch["ids"]
    flat, ends = ids.flatten().to_numpy().astype("<u4"), np.cumsum(ids.value_lengths().fill_null(0).to_numpy())
    at = 0
    for end in ends.tolist():
        own = flat[at:end]
        raw = b"".join(map(names.__getitem__, own.tolist()))
        yield own, raw.decode("utf-8", "replace").encode()
        at = end


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids`` in UTF-8 (added tokens
    included; bytes that are no UTF-8 become U+FFFD)."""
    names = encoded.sparkSession.sparkContext.broadcast(load(path).bytes)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            text = [raw for _, raw in _decoded(batch, names.value)]
            yield pa.record_batch({"doc_id": batch["doc_id"], "ids": batch["ids"], "decoded": pa.array(text, pa.binary())})

    return bounded_batches(encoded).select("doc_id", "ids").mapInArrow(run, DECODED)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of ``encoded``: number of tokens, digest of the ids as little-endian
    unsigned 32-bit integers, digest of the decoded text."""
    names = encoded.sparkSession.sparkContext.broadcast(load(path).bytes)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = [(len(own), sha256(own.tobytes()).hexdigest(), sha256(raw).hexdigest())
                    for own, raw in _decoded(batch, names.value)]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64()),
                "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(text, pa.string())})

    return bounded_batches(encoded).select("doc_id", "ids").mapInArrow(run, DIGESTS)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of every text's tokens and of the text they decode to."""
    return digests(encode(docs, path), path)
