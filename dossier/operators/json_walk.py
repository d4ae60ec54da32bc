"""JSON payloads as rows of their nodes, at any depth: one pass over a payload's tokens, without recursion.

Payloads are read by the variant reader first; what it can't read gives no rows. The pass keeps a stack of open objects and
lists, so time and memory grow with the payload and not with its depth; values stay as they are written until the few that
are wanted are read as variants.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')
#: Levels that an object's row shows of what lies below it; facts look no deeper.
SHOWN = 4
MASK = "[REDACTED]"


class _Open:
    """An object or list that has not ended: its path, the key or number that is next, and where it starts."""

    __slots__ = ("path", "is_list", "key", "own_key", "start", "n", "full", "shown", "types")

    def __init__(self, path: str, is_list: bool, own_key: str | None, start: int):
        self.path, self.is_list, self.own_key, self.start = path, is_list, own_key, start
        self.key, self.n, self.full, self.shown, self.types = None, 0, False, [], None

    def step(self) -> tuple[str, str | None]:
        """The path and key of the value that comes next."""
        return (f"{self.path}[{self.n}]", None) if self.is_list else (f"{self.path}.{self.key}", self.key)


def leaves_of(payload: str) -> Iterator[tuple[str, str | None, str]]:
    """path, key, value (as written) of each value that is no object or list, or is an empty one."""
    stack: list[_Open] = []
    for m in _TOKEN.finditer(payload):
        t, top = m[0], stack[-1] if stack else None
        if t in ",:":
            if t == ",":
                top.n, top.key = top.n + 1, None
        elif t in "{[":
            stack.append(_Open(*((top.step()[0], t == "[", top.key) if top else ("$", t == "[", None)), m.start()))
        elif t in "}]":
            stack.pop()
            if not top.full:
                yield top.path, top.own_key, "{}" if t == "}" else "[]"
        elif top and not top.is_list and top.key is None:
            top.key = json.loads(t)
        else:
            yield (*(top.step() if top else ("$", None)), t)
        if top and t not in ",:}]":
            top.full = True


def objects_of(payload: str) -> Iterator[tuple[str, str | None, str]]:
    """path, type (of a string under @type), object as written to SHOWN levels below it, deeper ones as null."""
    stack: list[_Open] = []

    def show(piece: str) -> None:
        for f in stack[-SHOWN:]:
            f.shown.append(piece)

    for m in _TOKEN.finditer(payload):
        t, top = m[0], stack[-1] if stack else None
        if t in "{[":
            if len(stack) >= SHOWN:
                stack[-SHOWN].shown.append("null")
            stack.append(_Open(top.step()[0] if top else "$", t == "[", None, m.start()))
            show(t)
            continue
        show(t)
        if t == ",":
            top.n, top.key = top.n + 1, None
        elif t in "}]":
            stack.pop()
            if t == "}":
                yield top.path, top.types, "".join(top.shown)
        elif t != ":" and top and not top.is_list:
            if top.key is None:
                top.key = json.loads(t)
            elif top.key == "@type" and t[0] == '"':
                top.types = json.loads(t)


def secret(key: str | None) -> bool:
    return key is not None and any(word in key.lower() for word in text.SENSITIVE)


def redacted_of(payload: str) -> tuple[str, list[tuple[str, str | None]]]:
    """The payload with all values of secret-like keys masked, and path and value (null for masked ones) of its leaves.

    Objects are entered, lists stand as they are.
    """
    stack: list[_Open] = []
    out, leaves, at = [], [], 0
    masked = listed = None  # the depth at which a masked value, or a list, ends
    depth = start = 0
    path = "$"

    def ends(t: str, own: str, begin: int, end: int, hidden: bool) -> None:
        nonlocal at
        if hidden:
            out.extend((payload[at:begin], f'"{MASK}"'))
            at = end
        leaves.append((own, None if hidden else payload[begin:end]))

    for m in _TOKEN.finditer(payload):
        t, top = m[0], stack[-1] if stack else None
        if masked is not None or listed is not None:  # within a value that is not entered
            depth += (t in "{[") - (t in "}]")
            if depth == 0 and t in "}]":
                ends(t, path, start, m.end(), masked is not None)
                masked = listed = None
            continue
        if t == ",":
            top.key = None
        elif t == ":":
            continue
        elif top and top.key is None and t != "}":
            top.key, top.n = json.loads(t), 1
        elif t == "}":
            stack.pop()
            if not top.n:
                ends(t, top.path, top.start, m.end(), False)
        else:
            own, key = top.step() if top else ("$", None)
            hidden = secret(key)
            if t == "[" or (t == "{" and hidden):
                masked, listed, depth, start, path = (1 if hidden else None), (None if hidden else 1), 1, m.start(), own
            elif t == "{":
                stack.append(_Open(own, False, key, m.start()))
            else:
                ends(t, own, m.start(), m.end(), hidden)
    out.append(payload[at:])
    return "".join(out), leaves


def _walked(rows: DataFrame, id_: list[str], json_column: str, schema: str, of: Callable[[str], list[tuple]]) -> DataFrame:
    """id columns and schema's of what a function finds in each payload that can be read."""
    own = rows.select(*id_, F.col(json_column).alias("__json")).where(F.try_parse_json("__json").isNotNull())
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in id_)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                whose, found = [], []
                for k, payload in enumerate(part.column(len(id_)).to_pylist()):
                    mine = of(payload)
                    whose += [k] * len(mine)
                    found += mine
                index = pa.array(whose, pa.int64())
                columns = [pa.array([f[i] for f in found], pa.string()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(index) for i in range(len(id_))), *columns], [*id_, *names])

    return own.mapInArrow(run, f"{kinds}, {schema}")


def json_paths(rows: DataFrame, id_: list[str], json_column: str) -> DataFrame:
    """id columns and path of every leaf of a JSON payload, like $.a.b[0]; an empty object or list is a leaf as well."""
    return _walked(rows, id_, json_column, "path string", lambda p: [(path,) for path, _, _ in leaves_of(p)])


def json_objects(rows: DataFrame, id_: list[str], json_column: str) -> DataFrame:
    """id columns, path, type, value (variant, to SHOWN levels below) of every object of a JSON payload."""
    found = _walked(rows, id_, json_column, "path string, type string, raw string", lambda p: list(objects_of(p)))
    return found.select(*id_, "path", "type", F.parse_json("raw").alias("value"))


def redacted_paths(rows: DataFrame, id_: list[str], json_column: str) -> DataFrame:
    """id columns, path, value (JSON text) of every leaf of nested metadata, secret-like keys and all below them redacted.

    Objects are entered, lists stand as they are.
    """
    found = _walked(rows, id_, json_column, "path string, raw string", lambda p: redacted_of(p)[1])
    return found.select(*id_, "path", F.when(F.col("raw").isNull(), MASK).otherwise(F.to_json(F.parse_json("raw"))).alias("value"))


def redacted_rows(rows: DataFrame, id_: list[str], json_column: str) -> DataFrame:
    """id columns and the payload (JSON text) with all values of secret-like keys masked, at any depth.

    A payload that can't be read can't be looked through, so it is masked as a whole; a null stays one.
    """
    read = _walked(rows, id_, json_column, f"{json_column} string", lambda p: [(redacted_of(p)[0],)])
    read = read.select(*id_, F.to_json(F.parse_json(json_column)).alias(json_column))
    rest = rows.select(*id_, F.col(json_column).alias(json_column)).where(F.try_parse_json(json_column).isNull())
    return read.unionByName(rest.withColumn(json_column, F.when(F.col(json_column).isNotNull(), F.lit(f'"{MASK}"'))))


def shown(value: Column) -> Column:
    """How a JSON value is shown: a string by itself, all else as JSON."""
    v = F.try_parse_json(value)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
