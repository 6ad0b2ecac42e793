"""A manifest of documents as hash trees, with a witness for every document.

One tree per language, its leaves in ascending ``doc_id``, and a tree over the
roots of these trees.  Eight consecutive nodes (the last run: fewer, even one)
become one, until one is left.

Nodes are appended in order to blocks of ``BLOCK`` positions, aligned so that a
block is a whole subtree.  An ``Appender`` keeps the open subtrees of its block
with the partial witnesses of what lies in them; each run that completes extends
these witnesses by the run's other nodes.  Blocks are independent, so Spark deals
them to tasks whatever the size of a tree.  The roots of blocks are further appends,
to blocks of the next tier, and the witness found there goes on from the one
found below, which the lower tier receives as the first row of its block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, settle

ARITY = 8
LEVELS = 3
BLOCK = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STEP = pa.struct([("place", pa.int32()), ("others", pa.string())])
WITNESS = "witness array<struct<place:int,others:string>>"
ROOTS = "tree string, idx long, total long, digest binary"
GROWN = f"tree string, idx long, doc_id long, digest binary, claim binary, {WITNESS}, subroot string, root string"
CHECKED = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
           "folded_root string, verified boolean")


def hashed(parts: Iterable[str]) -> str:
    """Lowercase hex SHA-256 of concatenated texts."""
    return sha256("".join(parts).encode()).hexdigest()


def height(total: int) -> int:
    """Levels that a block of a tree with ``total`` nodes adds."""
    levels = 0
    while levels < LEVELS and ARITY ** levels < total:
        levels += 1
    return levels


class Appender:
    """Appends nodes to one block; ``open[level]`` are complete subtrees without a parent."""

    def __init__(self, levels: int):
        self.open: list[list[tuple[str, list]]] = [[] for _ in range(levels + 1)]

    def append(self, digest: str, witness: list | None = None) -> None:
        """Add a node; ``witness`` (a list) grows as later siblings complete its runs."""
        self.open[0].append((digest, [] if witness is None else [witness]))
        level = 0
        while level < len(self.open) - 1 and len(self.open[level]) == ARITY:
            self._complete(level)
            level += 1

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        names = [digest for digest, _ in run]
        inside: list[list] = []
        for place, (_, witnesses) in enumerate(run):
            if witnesses:
                step = (place, "".join(names[:place] + names[place + 1:]))
                for witness in witnesses:
                    witness.append(step)
                inside += witnesses
        self.open[level + 1].append((hashed(names), inside))

    def finish(self) -> str:
        """Close the runs that are still open and return the root of the block."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._complete(level)
        return self.open[-1][0][0]


def folded(leaf: str, witness: list[tuple[int, str]]) -> str:
    """The root that ``leaf`` leads to with the siblings of ``witness``."""
    for place, others in witness:
        at = place * len(leaf)
        leaf = hashed((others[:at], leaf, others[at:]))
    return leaf


def _leaf(text) -> F.Column:
    def part(c) -> F.Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    columns = [part(text if c == "text" else F.col(c)) for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*columns), 256))


def leaves(docs: DataFrame, tampered: F.Column | None = None) -> DataFrame:
    """``doc_id, tree`` (the language), ``digest`` and ``claim`` of every document.

    ``claim`` is the leaf that will be checked against the manifest: that of the
    document with its text in lower case (A-Z) where ``tampered`` holds.
    """
    held = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    changed = _leaf(F.translate("text", UPPER, LOWER))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("tree"),
                       _leaf(F.col("text")).alias("digest"), F.when(held, changed).alias("claim"))


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``idx``, their rank in their tree, and ``total``, its size.

    Rows are sorted once, over all partitions; a tree's part in each partition is
    one row of ``spans``, so that no tree is ordered in one task.
    """
    keys = [F.asc_nulls_first(c) for c in ("tree", *order)]
    ordered = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settle(ordered.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33).alias("part")
    spans = placed.groupBy("tree", part).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part")) - F.col("n")
    spans = settle(spans.select(
        F.col("tree").alias("of"), F.col("part").alias("in"), (F.col("start") - before).alias("offset"),
        F.sum("n").over(Window.partitionBy("tree")).alias("total")), "spans")
    match = F.col("tree").eqNullSafe(F.col("of")) & (F.shiftright("at", 33) == F.col("in"))
    return placed.join(spans, match).select(*nodes.columns, (F.col("at") - F.col("offset")).alias("idx"), "total")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Each block in one partition, its rows in order."""
    blocked = nodes.withColumn("block", F.expr(f"case when idx < 0 then -idx - 1 else idx div {BLOCK} end"))
    return bounded_batches(blocked).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def _by_block(batches: Batches, opened: Callable, add: Callable, closed: Callable):
    """Walk sorted rows; what ``closed`` returns for each batch's ended blocks is yielded."""
    state, key = None, None
    for batch in batches:
        done: list = []
        names = batch.schema.names
        for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
            row = dict(zip(names, row, strict=True))
            if state is None or key != (row["tree"], row["block"]):
                if state is not None:
                    closed(state, done)
                state, key = opened(row), (row["tree"], row["block"])
            add(state, row)
        yield done
    if state is not None:
        done = []
        closed(state, done)
        yield done


def _climb(batches: Batches) -> Batches:
    """The root of every block, as a node of the next tier."""
    def opened(row):
        return Appender(height(row["total"])), row["tree"], row["block"], -(-row["total"] // BLOCK)

    def add(state, row):
        state[0].append(row["digest"].hex())

    def closed(state, done):
        done.append((*state[1:], bytes.fromhex(state[0].finish())))

    for done in _by_block(batches, opened, add, closed):
        tree, idx, total, digest = zip(*done, strict=True) if done else ([],) * 4
        yield pa.record_batch({
            "tree": pa.array(tree, pa.string()), "idx": pa.array(idx, pa.int64()),
            "total": pa.array(total, pa.int64()), "digest": pa.array(digest, pa.binary())})


def _grow(batches: Batches) -> Batches:
    """Every node of a block with its witness up to the root of all trees.

    The first row of a block (a negative ``idx``) brings the witness of the block's
    own root; the block's nodes are appended after it.
    """
    def opened(row):
        return {"above": row, "levels": None, "rows": []}

    def add(state, row):
        if row["idx"] < 0:
            return
        if state["levels"] is None:
            state["levels"] = Appender(height(row["total"]))
        witness: list = []
        state["levels"].append(row["digest"].hex(), witness)
        state["rows"].append((row["idx"], row["doc_id"], row["digest"], row["claim"], witness))

    def closed(state, done):
        if state["levels"] is None:
            return
        state["levels"].finish()
        above = state["above"]
        rest = [(s["place"], s["others"]) for s in above["witness"]]
        for idx, doc_id, digest, claim, witness in state["rows"]:
            steps = [{"place": p, "others": o} for p, o in witness + rest]
            done.append((above["tree"], idx, doc_id, digest, claim, steps,
                         above["subroot"], above["root"]))

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(STEP), pa.string(), pa.string())
    names = ("tree", "idx", "doc_id", "digest", "claim", "witness", "subroot", "root")
    for done in _by_block(batches, opened, add, closed):
        for at in range(0, len(done), BLOCK):
            columns = zip(*done[at:at + BLOCK], strict=True)
            yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the block roots above them, up to one node for each tree."""
    tiers = [nodes]
    while (nodes.agg(F.max("total")).first()[0] or 0) > 1:
        nodes = settle(_blocks(nodes.select("tree", "idx", "total", "digest")).mapInArrow(_climb, ROOTS), "roots")
        tiers.append(nodes)
    return tiers


def _down(tiers: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """Witnesses of the nodes of the lowest tier; ``above`` has those of the trees' roots."""
    for k, nodes in enumerate(reversed(tiers)):
        last = k == len(tiers) - 1
        for c, kind in (("doc_id", "long"), ("claim", "binary")):
            if not last or c not in carried:
                nodes = nodes.withColumn(c, F.lit(None).cast(kind))
        both = nodes.unionByName(above.withColumn("idx", -F.col("block") - 1).drop("block"), allowMissingColumns=True)
        grown = _blocks(both).mapInArrow(_grow, GROWN)
        if last:
            return grown
        grown = settle(grown, "witnesses")
        above = grown.select("tree", F.col("idx").alias("block"), "witness", "subroot", "root")
    raise AssertionError("no tiers")


def witnesses(nodes: DataFrame) -> DataFrame:
    """The manifest of ``leaves``: each with ``witness``, ``subroot`` and ``root``.

    ``witness`` has, for each level up to the root of all trees, the node's ``place``
    in its run and the run's other nodes, concatenated.  Leaves of one language
    ascend by ``doc_id`` (null first; ties by leaf, then claim); languages by their
    bytes, null first.  Repeated rows are leaves of their own.  An empty table has
    an empty manifest.
    """
    nodes = _placed(settle(nodes, "leaves"), "doc_id", "digest", "claim")
    tiers = _tiers(nodes)
    roots = tiers[-1].select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "digest")
    named = settle(_placed(roots, "name"), "subroots")
    upper = _tiers(named.drop("name"))
    top = upper[-1].select(
        "tree", F.col("idx").alias("block"), F.expr(f"cast(array() as {WITNESS.split(' ', 1)[1]})").alias("witness"),
        F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    grown = settle(_down(upper, top, []), "languages").select("idx", "witness", "root")
    above = grown.join(named.select("idx", "name", "digest"), "idx").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "witness",
        F.lower(F.hex("digest")).alias("subroot"), "root")
    return _down(tiers, above, ["doc_id", "claim"]).select(
        "doc_id", F.col("tree").alias("lang"), F.col("digest").alias("leaf"), "claim", "witness", "subroot", "root")


def _check(batches: Batches) -> Batches:
    names = [x.split()[0] for x in CHECKED.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    for batch in batches:
        done = []
        for doc_id, leaf, claim, witness, subroot, root in zip(*(
                batch[c].to_pylist() for c in ("doc_id", "leaf", "claim", "witness", "subroot", "root")), strict=True):
            steps = [(s["place"], s["others"]) for s in witness]
            top = folded((claim or leaf).hex(), steps)
            done.append((doc_id, leaf.hex(), subroot, root, hashed(o for _, o in steps), top, top == root))
        columns = zip(*done, strict=True) if done else [[]] * len(names)
        yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def verified(manifest: DataFrame) -> DataFrame:
    """Fold each claim (or leaf) of a manifest with its witness and compare the root."""
    return bounded_batches(manifest).mapInArrow(_check, CHECKED)


def manifest_report(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs``, checked against them with the text of every document in
    lower case whose crc32 of the decimal ``doc_id`` is divisible by 3.

    A null ``doc_id`` is never tampered with.  Other columns are not read.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return verified(witnesses(leaves(docs, tampered)))
