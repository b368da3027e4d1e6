"""Flat tables from nested JSON records by interval labels.

Every node of a record gets a pre-order and a post-order number by one depth-first walk. A node A contains a node B
of the same record exactly if A.pre < B.pre and A.post > B.post. Nodes are emitted as one table with a type per node
(a path pattern); tables of a type are selections of it and are linked by containment, so no path has to be parsed
again and no key has to be unique. What no pattern names belongs to the field table of the nearest named node above it,
so every scalar of a payload is in exactly one table.

Payloads of any depth are read: where the standard reader gives up, one without recursion takes over.

Defined results: null payloads and payloads that are no JSON give no nodes, but a row of rejects() with the reason; of a
member named twice the last counts;
empty tables give empty tables; extra columns are ignored. The numbers restart with each record, hence a record
delivered again under another id is simply another record.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from enum import Enum
from json.decoder import scanstring

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Any(Enum):
    """Components of a path pattern besides a member's name."""

    KEY = 1
    INDEX = 2


KEY, INDEX = Any.KEY, Any.INDEX

NODE_SCHEMA = "record_id long, node_type string, pre int, post int, depth int, kind string, node_key string, value string"


_SPACE = regex.compile(r"[ \t\n\r]*+")
_SCALAR = regex.compile(r"(?P<n>-?(?:0|[1-9][0-9]*+)(?P<f>\.[0-9]++)?(?P<e>[eE][-+]?[0-9]++)?)|true|false|null|NaN|-?Infinity")
_NAMED = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def read_deep(text: str) -> object:
    """The value of a JSON text, whatever its depth; ValueError if it is none. As json.loads, but with a stack of its own."""
    stack: list[tuple[object, str | None]] = []  # open containers, and the name under which the next one goes into each
    at = _SPACE.match(text, 0).end()
    while True:
        opened = text[at : at + 1]
        if opened in ("{", "["):
            value: object = {} if opened == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if opened == "{" else "]"):
                stack.append((value, None))
                if opened == "{":
                    at = _name(text, at, stack)
                continue
            at += 1
        elif opened == '"':
            value, at = scanstring(text, at + 1)
        elif m := _SCALAR.match(text, at):
            value = _NAMED[m[0]] if m["n"] is None else float(m[0]) if m["f"] or m["e"] else int(m[0])
            at = m.end()
        else:
            raise ValueError(f"no value at {at}")
        while True:  # value is complete: put it in its container, and close what ends here
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != len(text):
                    raise ValueError(f"text behind the value at {at}")
                return value
            holder, name = stack[-1]
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            sign = text[at : at + 1]
            at = _SPACE.match(text, at + 1).end()
            if sign == ",":
                if isinstance(holder, dict):
                    at = _name(text, at, stack)
                break
            if sign != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"no comma or end before {at}")
            value = stack.pop()[0]


def _name(text: str, at: int, stack: list) -> int:
    """Read a member's name and colon; the place of its value."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    name, at = scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    stack[-1] = (stack[-1][0], name)
    return _SPACE.match(text, at + 1).end()


def payload_of(payload: str | None) -> tuple[object, str | None]:
    """The value of a payload and no reason, or nothing and the reason why it cannot be read."""
    if payload is None:
        return None, "null"
    try:
        try:
            return json.loads(payload), None
        except RecursionError:
            return read_deep(payload), None
        except ValueError as e:
            if "integer string conversion" not in str(e):
                return None, "json"
            sys.set_int_max_str_digits(0)  # whole numbers of any length
            return payload_of(payload)
    except ValueError:
        return None, "json"


def rejects(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """record_id, reason of the records that give no nodes: `null` for no payload, `json` for one that is no JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, r) for i, r in ((i, payload_of(p)[1]) for i, p in zip(b.iloc[:, 0], b.iloc[:, 1])) if r]
            yield pd.DataFrame(rows, columns=["record_id", "reason"]).astype({"record_id": "int64"})

    src = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(payload_col).alias("payload")).where("record_id is not null")
    return src.mapInPandas(run, "record_id long, reason string")


def _kind(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    return {dict: "object", list: "array", str: "string"}.get(type(x), "number")


def _text(x: str) -> str:
    """x with lone surrogates, which JSON can hold but no Arrow string, replaced by U+FFFD."""
    return x if x.isascii() else x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _trie(types: list[tuple[str, tuple]]) -> dict:
    root: dict = {}
    for name, path in types:
        at = root
        for part in path:
            at = at.setdefault(part, {})
        at[None] = name
    return root


def walk(root: object, trie: dict, rest: dict[str, str] | None = None) -> list[tuple]:
    """(type, pre, post, depth, kind, key, value) of each node that a pattern names. Iterative, whatever the depth.

    rest gives the type of the unnamed nodes below a node of a named type; without it they are left out.
    """
    out: list[list] = []
    pre = post = 0
    rest = rest or {}
    stack: list[tuple] = [(root, "", (trie,), 0, None, None)]
    while stack:
        node, key, at, depth, leaving, below_type = stack.pop()
        if leaving is not None:
            if leaving >= 0:
                out[leaving][2] = post
            post += 1
            continue
        kind = _kind(node)
        name = next((t[None] for t in at if None in t), None)
        below_type, name = rest.get(name, below_type), name or below_type
        slot = -1
        if name is not None:
            value = _text(node) if kind == "string" else None if kind in ("null", "object", "array") else json.dumps(node)
            slot = len(out)
            out.append([name, pre, 0, depth, kind, _text(key), value])
        pre += 1
        stack.append((None, "", (), depth, slot, None))
        if kind == "object":
            children = [(v, k, tuple(t[p] for t in at for p in (k, KEY) if p in t)) for k, v in node.items()]
        elif kind == "array":
            below = tuple(t[INDEX] for t in at if INDEX in t)
            children = [(v, str(i), below) for i, v in enumerate(node)]
        else:
            continue
        for v, k, below in reversed(children):
            stack.append((v, k, below, depth + 1, None, below_type))
    return [tuple(x) for x in out]


def label(df: DataFrame, id_col: str, payload_col: str, types: list[tuple[str, tuple]], rest: dict[str, str] | None = None) -> DataFrame:
    """The typed nodes of every record; rest as in walk."""
    names = NODE_SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = _trie(types)
        for b in batches:
            rows: list[tuple] = []
            for rid, payload in zip(b.iloc[:, 0], b.iloc[:, 1]):
                root, reason = payload_of(payload)
                if reason:
                    continue
                rows += [(rid, *x) for x in walk(root, trie, rest)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names).astype({"record_id": "int64", "pre": "int32", "post": "int32", "depth": "int32"})

    src = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(payload_col).alias("payload")).where("record_id is not null and payload is not null")
    return src.mapInPandas(run, NODE_SCHEMA)


def contained(nodes: DataFrame, parent: str, child: str) -> DataFrame:
    """The nodes of type child, each with pre, post, key and kind of the parent node whose interval holds it.

    Parents of one type do not nest, so the container of a child is the last parent that begins before it, if that
    parent also ends after it. The window holds one record at a time, never more than one payload had.
    """
    w = Window.partitionBy("record_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    is_parent = F.col("node_type") == parent
    tagged = nodes.where(F.col("node_type").isin(parent, child)).withColumn(
        "up", F.last(F.when(is_parent, F.struct("pre", "post", F.col("node_key").alias("key"), "kind")), ignorenulls=True).over(w)
    )
    return tagged.where((F.col("node_type") == child) & (F.col("up.post") > F.col("post"))).select(
        "record_id", "pre", "post", "depth", "kind", "node_key", "value",
        F.col("up.pre").alias("parent_pre"), F.col("up.key").alias("parent_key"), F.col("up.kind").alias("parent_kind"),
    )


def linked(nodes: DataFrame, parents: dict[str, str]) -> DataFrame:
    """Every node with parent_pre, parent_key and parent_kind of the node of the type parents[node_type] that holds it.

    As contained(), for all types in one window; nodes of a type without a parent have nulls there.
    """
    w = Window.partitionBy("record_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    ups = sorted(set(parents.values()))
    last = lambda p: F.last(F.when(F.col("node_type") == p, F.struct("pre", "post", F.col("node_key").alias("key"), "kind")), ignorenulls=True).over(w)
    tagged = nodes.select("*", *[last(p).alias(f"up_{p}") for p in ups])
    up = F.coalesce(*[F.when(F.col("node_type").isin(*[c for c, q in parents.items() if q == p]), F.col(f"up_{p}")) for p in ups])
    return tagged.withColumn("up", up).where(~F.col("node_type").isin(*parents) | (F.col("up.post") > F.col("post"))).select(
        *nodes.columns, F.col("up.pre").alias("parent_pre"), F.col("up.key").alias("parent_key"), F.col("up.kind").alias("parent_kind")
    )


# -- the project's two record shapes ----------------------------------------------------------------------------------

TRANSCRIPTION = [
    ("record", ()),
    ("model", ("transcript", KEY)),
    ("segment", ("transcript", KEY, INDEX)),
    ("segment", ("transcript", KEY, "segments", INDEX)),
    ("word", ("transcript", KEY, INDEX, "words", INDEX)),
    ("word", ("transcript", KEY, "segments", INDEX, "words", INDEX)),
]
RESULT_FILE = [
    ("file", ()),
    ("result", ("results", INDEX)),
    ("metric", ("results", INDEX, "metrics", KEY)),
    ("op", ("results", INDEX, "alignment", INDEX)),
]
#: The parent's type of each type; a type with _field holds whatever else lies below its parent, at any depth.
TRANSCRIPTION_PARENTS = {"record_field": "record", "model": "record", "model_field": "model", "segment": "model", "segment_field": "segment", "word": "segment", "word_field": "word"}
RESULT_FILE_PARENTS = {"file_field": "file", "result": "file", "result_field": "result", "metric": "result", "metric_field": "metric", "op": "result", "op_field": "op"}


def segments_of(value: object) -> list:
    """(position, element) of the segments in one model's value, null elements left out."""
    if isinstance(value, dict):
        value = value.get("segments")
        if isinstance(value, str):
            return []
    if isinstance(value, str):
        return [(0, value)]
    return [(i, x) for i, x in enumerate(value) if x is not None] if isinstance(value, list) else []


def segment_text(element: object) -> str:
    """The text of one segment in any of its shapes; what holds no text gives the empty text."""
    if isinstance(element, dict):
        element = element.get("text")
    elif isinstance(element, list):
        element = element[1] if len(element) > 1 else None
    return element if isinstance(element, str) else ""


def links(transcription: DataFrame, result_files: DataFrame) -> DataFrame:
    """kind, record_id, parent_key, child_key of segments, metric values and alignment steps. Each payload is read and
    labelled once."""
    t = linked(label(transcription, "record_id", "payload", [x for x in TRANSCRIPTION if x[0] in ("model", "segment")]), {"segment": "model"})
    r = linked(label(result_files, "record_id", "payload", [x for x in RESULT_FILE if x[0] in ("result", "metric", "op")]), {"metric": "result", "op": "result"})
    whole = (F.col("node_type") == "model") & (F.col("kind") == "string")  # a model's text is its segment
    seg = t.where(whole | (F.col("node_type") == "segment") & (F.col("kind") != "null")).select(
        F.lit("segment").alias("kind"), "record_id", F.when(whole, F.col("node_key")).otherwise(F.col("parent_key")).alias("parent_key"), F.when(whole, "0").otherwise(F.col("node_key")).alias("child_key")
    )
    rest = r.where((F.col("node_type") == "op") | (F.col("node_type") == "metric") & (F.col("kind") != "null")).select(F.col("node_type").alias("kind"), "record_id", "parent_key", F.col("node_key").alias("child_key"))
    return seg.unionByName(rest)


def all_nodes(transcription: DataFrame, result_files: DataFrame) -> DataFrame:
    """Every node of both tables, each with its type and the interval label of its parent.

    A model whose value is a string has a segment at position 0 that shares the model's label.
    """
    types = lambda parents: {p: f"{p}_field" for p in parents.values()}
    t = linked(label(transcription, "record_id", "payload", TRANSCRIPTION, types(TRANSCRIPTION_PARENTS)), TRANSCRIPTION_PARENTS)
    r = linked(label(result_files, "record_id", "payload", RESULT_FILE, types(RESULT_FILE_PARENTS)), RESULT_FILE_PARENTS)
    whole = (F.col("node_type") == "model") & (F.col("kind") == "string")
    t = t.withColumn("as", F.explode(F.when(whole, F.array(F.lit("model"), F.lit("segment"))).otherwise(F.array("node_type"))))
    extra = whole & (F.col("as") == "segment")
    either = lambda a, b: F.when(extra, a).otherwise(F.col(b)).alias(b)
    t = t.select(
        "record_id", F.col("as").alias("node_type"), "pre", "post", "depth", "kind", either(F.lit("0"), "node_key"), "value",
        either(F.col("pre"), "parent_pre"), either(F.col("node_key"), "parent_key"), either(F.col("kind"), "parent_kind"),
    )
    return t.unionByName(r)


def tables(transcription: DataFrame, result_files: DataFrame) -> dict[str, DataFrame]:
    """The node tables by type, each row with the interval label of its parent; record and file rows have none."""
    nodes = all_nodes(transcription, result_files)
    names = ["record", *TRANSCRIPTION_PARENTS, "file", *RESULT_FILE_PARENTS]
    return {name: nodes.where(F.col("node_type") == name).drop("node_type") for name in names}
