"""Deeply nested records to flat tables that keep their parents: adjacency-table shredding."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.functions.jsontext import NotJson, loads
from frameloom.runtime import fresh_name

FLUSH_ROWS = 50_000
_NODE = ["key", "rec", "node", "parent", "label", "ordinal", "kind", "scalar"]
_KINDS = {dict: "object", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def _flat(value: list) -> list:
    """Arrays within arrays count on in one sequence, so that ordinals stay unique within a label."""
    if not any(isinstance(x, list) for x in value):
        return value
    out, todo = [], [iter(value)]
    while todo:
        for x in todo[-1]:
            if isinstance(x, list):
                todo.append(iter(x))
                break
            out.append(x)
        else:
            todo.pop()
    return out


def _walk(value, first: int, roots: frozenset | None, fields: frozenset | None, embedded: bool, out: list[tuple]) -> int:
    """Appends (node, parent, label, ordinal, kind, scalar) in document order; ``first`` numbers the first node. Returns the next number.

    An element of an array is a child of the object around the array and bears the array's key and its position.
    """
    number = first
    stack = [(value, None, None, 0, roots is None)]
    while stack:
        value, parent, label, ordinal, inside = stack.pop()
        if not inside:  # outside of the roots only what may hold one of them is looked at
            if isinstance(value, dict):
                stack += [(v, None, k, 0, k in roots) for k, v in reversed(value.items()) if k in roots or isinstance(v, (dict, list))]
            elif isinstance(value, list):
                stack += [(v, None, label, 0, False) for v in reversed(value) if isinstance(v, (dict, list))]
            continue
        if embedded and isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
            try:
                value = loads(value)
            except NotJson:
                pass
        if isinstance(value, dict):
            out.append((number, parent, label, ordinal, "object", None))
            stack += [(v, number, k, 0, True) for k, v in reversed(value.items()) if fields is None or k in fields or isinstance(v, (dict, list)) or embedded and isinstance(v, str) and v.lstrip()[:1] in ("{", "[")]
            number += 1
        elif isinstance(value, list):
            flat = _flat(value)
            stack += [(flat[i], parent, label, i, True) for i in range(len(flat) - 1, -1, -1)]
        elif fields is None or label in fields:
            out.append((number, parent, label, ordinal, _KINDS[type(value)], value if isinstance(value, str) else None if value is None else json.dumps(value)))
            number += 1
    return number


def _valid(text: str | None) -> str | None:
    """Lone surrogates, which no UTF-8 text can hold, become U+FFFD."""
    return None if text is None else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _strings(column) -> pa.Array:
    try:
        return pa.array(column, pa.string())
    except UnicodeEncodeError:
        return pa.array([_valid(x) for x in column], pa.string())


def shred(df: DataFrame, key: str, texts: list[str], roots: list[str] | None = None, fields: list[str] | None = None, embedded: bool = True) -> DataFrame:
    """The adjacency table of the JSON texts in the columns ``texts`` of each record.

    Columns: ``key``; ``rec``, a hash of the texts, so that different records under one key stay apart and the nodes of repeated
    deliveries are the same rows; ``node`` and ``parent`` (numbers within the record; parent null at the
    top), ``label`` (the key above), ``ordinal`` (position within its array, else 0), ``kind`` and ``scalar`` (as
    text). ``roots``: shred only what lies below these labels. ``fields``: keep only scalars of these labels. With
    ``embedded``, a string that is itself a complete JSON object or array is shredded in its place.

    A text that is null, empty or not complete JSON gives no nodes; other texts of its record do. Nulls in
    the tree are nodes of kind ``null``. Very long texts are handed on in pieces of bounded size. A null key is kept.
    Equal keys within one object: the last counts. A narrow pass: nodes of a copy of a record come again, ``entities`` merges them.
    """
    rec = fresh_name(df, "rec")
    narrow = df.select(F.col(key).alias("key"), F.xxhash64(*texts).alias(rec), *[F.col(t).alias(f"text{i}") for i, t in enumerate(texts)])
    key_type = df.schema[key].dataType
    roots_, fields_ = (None if x is None else frozenset(x) for x in (roots, fields))

    def run(batches):
        for batch in batches:
            keys, recs, *columns = batch.columns
            found, owners, counts = [], [], []

            def flush():
                node, parent, label, ordinal, kind, scalar = zip(*found)
                at = pa.array(np.repeat(np.array(owners, np.int64), counts))
                arrays = [keys.take(at), recs.take(at), pa.array(node, pa.int64()), pa.array(parent, pa.int64()), _strings(label), pa.array(ordinal, pa.int32()), pa.array(kind, pa.string()), _strings(scalar)]
                for x in (found, owners, counts):
                    x.clear()
                return pa.RecordBatch.from_arrays(arrays, _NODE)

            for i, row in enumerate(zip(*[c.to_pylist() for c in columns])):
                first, before = 0, len(found)
                for text in row:
                    if not text:
                        continue
                    try:
                        value = loads(text)
                    except NotJson:
                        continue
                    first = _walk(value, first, roots_, fields_, embedded, found)
                owners.append(i)
                counts.append(len(found) - before)
                if len(found) >= FLUSH_ROWS:
                    yield flush()
            if found:
                yield flush()

    kind = key_type.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, rec bigint, node bigint, parent bigint, label string, ordinal int, kind string, scalar string")


_ROW = "array<struct<node:bigint,parent:bigint,label:string,ordinal:int,kind:string,scalar:string>>"


def _column_nodes(value: Column, kind: T.DataType, label: str, parent: Column, ordinal: Column, fields: frozenset | None) -> Column | None:
    """The nodes at and below a nested value as one array; None where nothing of it is wanted."""
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.ArrayType):
            return _column_nodes(F.flatten(F.filter(value, lambda x: x.isNotNull())), inner, label, parent, ordinal, fields)
        if not isinstance(inner, T.StructType) and fields is not None and label not in fields:
            return None
        return F.flatten(F.transform(value, lambda x, i: _column_nodes(x, inner, label, parent, i, fields)))
    me = F.xxhash64(parent, F.lit(label), ordinal)
    row = lambda kind, scalar: F.array(F.struct(me.alias("node"), parent.alias("parent"), F.lit(label).alias("label"), ordinal.cast("int").alias("ordinal"), F.lit(kind).alias("kind"), scalar.alias("scalar")))
    nothing = F.array().cast(_ROW)
    if isinstance(kind, T.StructType):
        below = [_column_nodes(value[f.name], f.dataType, f.name, me, F.lit(0), fields) for f in kind.fields]
        every = F.concat(row("object", F.lit(None).cast("string")), *[F.coalesce(b, nothing) for b in below if b is not None])
        return F.when(value.isNotNull(), every).otherwise(nothing)
    if fields is not None and label not in fields:
        return None
    name = "string" if isinstance(kind, T.StringType) else "boolean" if isinstance(kind, T.BooleanType) else "number"
    return F.when(value.isNotNull(), row(name, value.cast("string"))).otherwise(nothing)


def shred_columns(df: DataFrame, key: str, columns: list[str], fields: list[str] | None = None) -> DataFrame:
    """The adjacency table of nested columns (structs and arrays of them), in the columns of ``shred`` and without leaving the JVM.

    A node's number is a hash of its parent's, its label and its ordinal; the columns themselves are labels at the top. Strings stay as
    they are, whatever they hold. Null structs, scalars, elements and arrays give no nodes, but elements keep their positions.
    Copies of a record give the same rows again. An empty table gives no rows."""
    kept = None if fields is None else frozenset(fields)
    top = F.lit(None).cast("bigint")
    every = [_column_nodes(F.col(c), df.schema[c].dataType, c, top, F.lit(0), kept) for c in columns]
    nodes = F.concat(*[F.coalesce(e, F.array().cast(_ROW)) for e in every if e is not None])
    return df.select(F.col(key).alias("key"), F.xxhash64(*columns).alias("rec"), F.inline(nodes))


def entities(nodes: DataFrame, fields: list[str], labels: list[str] | None = None, needed: str | None = None, lists: tuple[str, ...] = ()) -> DataFrame:
    """Object nodes joined with their scalar children, pivoted to one column per field.

    Columns: key, rec, node, parent, label, ordinal and ``fields`` (text; null where absent; of an array the first
    element), and for each of ``lists`` all of its scalars as an array of (ordinal, scalar). ``labels`` keeps objects under these keys; ``needed``
    names a field an object must have to count.

    The join is one grouping on (key, rec, number of the object): an object falls to itself and a scalar to its parent. So both sides are
    shuffled once together, already combined within their map task, and copies of a record melt into one wherever they meet.
    """
    is_object = F.col("kind") == "object"
    wanted = F.lit(True) if labels is None else F.col("label").isin(labels)
    rows = nodes.where((is_object & wanted) | (~is_object & F.col("label").isin([*fields, *lists]) & F.col("scalar").isNotNull()))
    at = F.when(is_object, F.struct("parent", "label", "ordinal"))
    own = lambda f, *what: F.when(~is_object & (F.col("label") == f), F.struct(*what))
    pivot = [F.min(own(f, "ordinal", "scalar"))["scalar"].alias(f) for f in fields]
    arrays = [F.array_sort(F.collect_set(own(f, "ordinal", "scalar"))).alias(f) for f in lists]
    met = rows.groupBy("key", "rec", F.when(is_object, F.col("node")).otherwise(F.col("parent")).alias("node")).agg(F.min(at).alias("at"), *pivot, *arrays).where("at is not null")
    if needed:
        met = met.where(F.col(needed).isNotNull())
    return met.select("key", "rec", "node", "at.parent", "at.label", "at.ordinal", *fields, *lists)


def children(parents: DataFrame, label: str, columns: list[str], child: str) -> DataFrame:
    """The child table of the scalars ``label``, gathered by ``entities`` as a list, with the parents' ``columns``."""
    return parents.select("key", "rec", *columns, F.inline(label)).withColumnsRenamed({"ordinal": "child_ordinal", "scalar": child})
