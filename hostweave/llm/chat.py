"""Chat formatting by schema fingerprints.

A record's layout is the tree of its nested field names.  Its hash selects a
declarative mapping that turns the record into canonical turns of role and text,
so prompt, instruction and message layouts can share one table.  Turns are then
written in one template with a loss mask, and can be read back exactly.

The template marks a turn as ``<|turn|>role``, new line, text, ``<|end|>``, new
line.  Control strings inside roles and texts get a backslash after their first
character and backslashes are doubled, so a text never holds a control string.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, bounded_batches

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: First characters of control strings, where the rest of one follows.
CONTROL = r"(<(?=\||/?s>|<SYS>>|</SYS>>)|\|(?=>)|\[(?=/?INST\]))"
LOSS_ROLE = "assistant"

#: Layout, and an expression of turns over the record ``v``.
MAPPINGS = {
    "OBJECT<messages: ARRAY<OBJECT<content, role>>>":
        "transform(try_variant_get(v, '$.messages', 'array<struct<role string, content string>>'), "
        "m -> struct(m.role as role, m.content as text))",
    "OBJECT<conversations: ARRAY<OBJECT<from, value>>>":
        "transform(try_variant_get(v, '$.conversations', 'array<struct<`from` string, value string>>'), "
        "m -> struct(m.`from` as role, m.value as text))",
    "OBJECT<completion, prompt>":
        "array(struct('user' as role, try_variant_get(v, '$.prompt', 'string') as text), "
        "struct('assistant' as role, try_variant_get(v, '$.completion', 'string') as text))",
    "OBJECT<prompt, response>":
        "array(struct('user' as role, try_variant_get(v, '$.prompt', 'string') as text), "
        "struct('assistant' as role, try_variant_get(v, '$.response', 'string') as text))",
    "OBJECT<instruction, output>":
        "array(struct('user' as role, try_variant_get(v, '$.instruction', 'string') as text), "
        "struct('assistant' as role, try_variant_get(v, '$.output', 'string') as text))",
    "OBJECT<input, instruction, output>":
        "array(struct('user' as role, concat_ws('\\n\\n', try_variant_get(v, '$.instruction', 'string'), "
        "nullif(try_variant_get(v, '$.input', 'string'), '')) as text), "
        "struct('assistant' as role, try_variant_get(v, '$.output', 'string') as text))",
    "OBJECT<role, text>":
        "array(struct(try_variant_get(v, '$.role', 'string') as role, try_variant_get(v, '$.text', 'string') as text))",
    "OBJECT<content, role>":
        "array(struct(try_variant_get(v, '$.role', 'string') as role, try_variant_get(v, '$.content', 'string') as text))",
}
#: Names that other layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(layout: str) -> str:
    return hashlib.md5(layout.encode()).hexdigest()


def layout_of(record: Column) -> Column:
    """The nested field names of a variant, without the types of its leaves."""
    schema = F.schema_of_variant(record)
    return F.regexp_replace(schema, r": (?!OBJECT|ARRAY)[A-Z_]+(\([0-9, ]+\))?", "")


def canonical_turns(records: DataFrame, payload: str = "payload", mappings: dict[str, str] = MAPPINGS) -> DataFrame:
    """Turns of ``records``: all other columns, ``fingerprint``, ``part``, ``role``, ``text``.

    ``payload`` is JSON text, a struct or a variant.  A record whose layout has no
    mapping, or that is no JSON, comes out once with a null role and text and its
    fingerprint (null: no JSON), so nothing is lost.
    """
    kind = records.schema[payload].dataType
    value = F.col(payload)
    if isinstance(kind, T.StringType):
        value = F.try_parse_json(value)
    elif isinstance(kind, T.StructType):
        value = F.to_variant_object(value)
    keep = [c for c in records.columns if c != payload]
    read = records.select(*keep, value.alias("v")).withColumn("fingerprint", F.md5(layout_of(F.col("v"))))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout, expression in mappings.items():
        turns = F.when(F.col("fingerprint") == fingerprint(layout), F.expr(expression)).otherwise(turns)
    parts = read.select(*keep, "fingerprint", F.posexplode_outer(turns).alias("part", "turn_"))
    role = F.col("turn_.role")
    for old, new in ROLES.items():
        role = F.when(F.col("turn_.role") == old, new).otherwise(role)
    return parts.select(*keep, "fingerprint", "part", role.alias("role"), F.col("turn_.text").alias("text"))


def escaped(value: Column) -> Column:
    doubled = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1\\\\")


def formatted_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with ``piece``, the turn in the template, and its loss mask.

    The mask is ``loss_start`` and ``loss_length`` in code points of the piece, 0
    long for roles that are not learned.  A null role or text counts as empty.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    made = turns.withColumn("__role", role).withColumn("__body", body)
    piece = F.concat(F.lit(OPEN), "__role", F.lit("\n"), "__body", F.lit(CLOSE))
    learned = F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False))
    return made.withColumns({
        "piece": piece,
        "loss_start": F.length("__role") + (len(OPEN) + 1),
        "loss_length": F.when(learned, F.length("__body")).otherwise(0),
    }).drop("__role", "__body")


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescaped(value: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], value)


def read_back(piece: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text."""
    turns = []
    for role, body in _TURN.findall(piece):
        turns.append((unescaped(role), _ESCAPE.sub(lambda m: m[1], body)))
    return turns


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def _digest(batches: Batches) -> Batches:
    state = None

    def closed() -> tuple:
        conv, n, turns, chars, loss, total = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    for batch in batches:
        done = []
        lines = zip(*(batch[c].to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_length")), strict=True)
        for conv, rows in groupby(lines, lambda x: x[0]):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(closed())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for _, piece, start, length in rows:
                for role, text in read_back(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                loss = _ESCAPE.sub(lambda m: m[1], piece[start:start + length])
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(piece)
        yield table(done)
    if state is not None:
        yield table([closed()])


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, what the formatted pieces say when read back.

    A digest over all turns is sequential by nature.  Pieces are streamed in order of
    ``turn, part``, so a conversation of any length needs constant memory.  Ties go by
    role and text; a null ``conv_id`` is one conversation.
    """
    ordered = pieces.select("conv_id", "turn", "part", "role", "text", "piece", "loss_start", "loss_length") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text")
    slim = ordered.select("conv_id", "piece", "loss_start", "loss_length")
    return bounded_batches(slim).mapInArrow(_digest, DIGESTS)
