"""Nested raw records as flat tables with parent links, by Dewey labels.

A label is the way from the record to a node: for each level the ordinal of the field and the place in it, so a role is
``[8, 0, 3, 1]``: field 8, its only value; in that field 3, place 1. A parent's label is the node's without its last
level, and so is its path (``author.roles[1]``, ``author``), so links need no join. Nodes of one schema path (``author``,
``author.roles``) make one table. The walk follows the schema of a column inside the JVM; JSON text, which has no schema
and no fixed depth, is walked in Python, to the same labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["levels", "nodes", "table_of", "text_nodes", "telegram_text_table", "discord_author_table", "discord_role_table", "discord_attachment_table", "instagram_share_table", "nested_nodes"]

_NODE = "array<struct<path:string,dewey:array<int>,kind:string,type:string,value:string,href:string>>"


def levels(df: DataFrame, column: str) -> dict[str, Column]:
    """Schema path -> array of ``label, path, node`` of a record, for a column of structs or arrays and all within it.

    Nulls are no nodes; places in arrays count over all elements. Arrays of plain values are nodes, too; struct fields
    of plain values are their node's own.
    """
    at = df.columns.index(column)
    out: dict[str, Column] = {}

    def node(label: Column, path: Column, x: Column) -> Column:
        return F.struct(label.alias("label"), path.alias("path"), x.alias("node"))

    def elements(kind: T.DataType, x: Column, label: Column, path: Column, ordinal: int) -> Column:
        """The nodes that a value gives: its elements, or itself."""
        step = lambda i: F.concat(label, F.array(F.lit(ordinal), i))
        if isinstance(kind, T.ArrayType):
            found = F.transform(x, lambda e, i: node(step(i), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), e))
            return F.filter(F.coalesce(found, F.array().cast(T.ArrayType(_node_type(kind.elementType)))), lambda n: n["node"].isNotNull())
        return F.filter(F.array(node(step(F.lit(0)), path, x)), lambda n: n["node"].isNotNull())

    def inside(f: T.StructField, ordinal: int):
        return lambda n: elements(f.dataType, n["node"][f.name], n["label"], F.concat(n["path"], F.lit(f".{f.name}")), ordinal)

    def walk(kind: T.DataType, found: Column, schema_path: str) -> None:
        out[schema_path] = found
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if isinstance(inner, T.StructType):
            for i, f in enumerate(inner.fields):
                if isinstance(f.dataType, (T.StructType, T.ArrayType)):
                    walk(f.dataType, F.flatten(F.transform(found, inside(f, i))), f"{schema_path}.{f.name}")

    kind = df.schema[column].dataType
    walk(kind, elements(kind, F.col(f"`{column}`"), F.array().cast("array<int>"), F.lit(column), at), column)
    return out


def _node_type(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("label", T.ArrayType(T.IntegerType())), T.StructField("path", T.StringType()), T.StructField("node", kind)])


def _parent_label(label: Column) -> Column:
    """A label without its last level; null for children of the record itself."""
    return F.when(F.size(label) > 2, F.slice(label, F.lit(1), F.size(label) - 2))


def _parent_path(path: Column) -> Column:
    """A path without its last level; null for children of the record itself."""
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[^.]*$", ""))


def nodes(df: DataFrame, *columns: str) -> DataFrame:
    """``rec_id, table, label, parent_label, path, parent_path``: all nodes of the columns; the table is read once."""
    name = lambda t: lambda n: F.struct(F.lit(t).alias("table"), n["label"].alias("label"), n["path"].alias("path"))
    found = [F.transform(x, name(t)) for c in columns for t, x in levels(df, c).items()]
    d = df.select("rec_id", F.explode(F.concat(*found)).alias("n")).select("rec_id", "n.*")
    return d.select("rec_id", "table", "label", _parent_label(F.col("label")).alias("parent_label"), "path", _parent_path(F.col("path")).alias("parent_path"))


def table_of(df: DataFrame, schema_path: str) -> DataFrame:
    """``rec_id, label, parent_label, path, parent_path, place, node``: the nodes of one schema path with their values."""
    d = df.select("rec_id", F.explode(levels(df, schema_path.split(".")[0])[schema_path]).alias("n")).select("rec_id", "n.*")
    return d.select("rec_id", "label", _parent_label(F.col("label")).alias("parent_label"), "path", _parent_path(F.col("path")).alias("parent_path"), F.element_at("label", -1).alias("place"), "node")


# ---- JSON text --------------------------------------------------------------------------------------------------


def _string(x: object) -> str | None:
    return x if isinstance(x, str) else None


def _refuse(name: str) -> None:
    raise ValueError(name)


def _read(text: str) -> object:
    """JSON of any depth: the library's reader, and where its recursion ends a reader with a stack of its own."""
    try:
        return json.loads(text, parse_constant=_refuse, parse_int=float)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str) -> object:
    plain = json.JSONDecoder(parse_constant=_refuse, parse_int=float)
    stack: list[tuple[object, str | None]] = []
    at, key = 0, None

    def skip(i: int) -> int:
        while i < len(text) and text[i] in " \t\r\n":
            i += 1
        return i

    while True:
        at = skip(at)
        c = text[at : at + 1]
        if c and c in "[{":
            stack.append(([] if c == "[" else {}, key))
            at = skip(at + 1)
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                if c == "{":
                    at, key = _name(text, at, skip)
                continue
            (value, key), at = stack.pop(), at + 1
        else:
            value, at = scanstring(text, at + 1) if c == '"' else plain.raw_decode(text, at)
        while True:  # a value is complete: it goes into what is open around it
            if not stack:
                if skip(at) != len(text):
                    raise ValueError("text behind the end")
                return value
            box, outer = stack[-1]
            if isinstance(box, list):
                box.append(value)
            else:
                box[key] = value
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(box, dict):
                    at, key = _name(text, at, skip)
                break
            if c != ("]" if isinstance(box, list) else "}"):
                raise ValueError("neither a comma nor an end")
            stack.pop()
            value, key, at = box, outer, at + 1


def _name(text: str, at: int, skip) -> tuple[int, str]:
    if text[at : at + 1] != '"':
        raise ValueError("no name")
    key, at = scanstring(text, at + 1)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError("no colon")
    return at + 1, key


def text_nodes(text: str | None, ordinal: int = 0) -> list[tuple]:
    """The nodes of one ``text`` value, parents first: strings and objects of the array, and of arrays ``text`` inside.

    Null, invalid JSON and anything but an array give none. Numbers, booleans, nulls and arrays directly inside an
    array are no nodes but count as places. Texts of any depth are read and walked with a stack. *ordinal* is the
    column's; a field ``text`` inside an object, the only one that is walked, has 0.
    """
    if text is None or not text.lstrip(" \t\r\n").startswith("["):
        return []
    try:
        top = _read(text)
    except ValueError:
        return []
    out: list[tuple] = []
    stack = [("text", [], ordinal, top)]
    while stack:
        path, label, field, items = stack.pop()
        for i, x in enumerate(items):
            here, dewey = f"{path}[{i}]", [*label, field, i]
            if isinstance(x, str):
                out.append((here, dewey, "string", None, x, None))
            elif isinstance(x, dict):
                inner = x.get("text")
                out.append((here, dewey, "object", _string(x.get("type")), _string(inner), _string(x.get("href"))))
                if isinstance(inner, list):
                    stack.append((f"{here}.text", dewey, 0, inner))
    return out


def telegram_text_table(raw: DataFrame) -> DataFrame:
    """``rec_id, path, parent_path, place, dewey, kind, type, value, href``: one row per node of an array ``text``.

    ``parent_path`` is null for children of the record itself and ``value`` the string, or an object's own ``text``
    where that is a string. Only texts that begin with a bracket reach Python, in Arrow batches, without other columns
    than the record's id; nesting has no fixed depth, which rules out a fixed stack of ``explode``.
    """
    ordinal = raw.columns.index("text")

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: text_nodes(t, ordinal) or None)

    walk = F.pandas_udf(batches, _NODE)
    hit = raw.where(F.col("text").rlike(r"^[ \t\r\n]*\[")).select("rec_id", walk("text").alias("n"))
    d = hit.select("rec_id", F.explode("n").alias("n")).select("rec_id", "n.*")
    return d.select("rec_id", "path", _parent_path(F.col("path")).alias("parent_path"), F.element_at("dewey", -1).alias("place"), "dewey", "kind", "type", "value", "href")


# ---- the tables of the raw records ------------------------------------------------------------------------------


def discord_author_table(raw: DataFrame) -> DataFrame:
    """``rec_id, label, parent_label, path, author_id, name, nickname``: one row per non-null author."""
    d = table_of(raw, "author")
    return d.select("rec_id", "label", "parent_label", "path", F.col("node.id").alias("author_id"), F.col("node.name").alias("name"), F.col("node.nickname").alias("nickname"))


def discord_role_table(raw: DataFrame) -> DataFrame:
    """``rec_id, label, parent_label, path, parent_path, place, role_id, name``: one row per non-null role."""
    d = table_of(raw, "author.roles")
    return d.select("rec_id", "label", "parent_label", "path", "parent_path", "place", F.col("node.id").alias("role_id"), F.col("node.name").alias("name"))


def discord_attachment_table(raw: DataFrame) -> DataFrame:
    """``rec_id, label, parent_label, path, place, attachment_id, url, file_name, file_size``: one row per non-null attachment."""
    d = table_of(raw, "attachments")
    n = lambda f: F.col(f"node.{f}")
    return d.select("rec_id", "label", "parent_label", "path", "place", n("id").alias("attachment_id"), n("url").alias("url"), n("fileName").alias("file_name"), n("fileSizeBytes").alias("file_size"))


def instagram_share_table(raw: DataFrame) -> DataFrame:
    """``rec_id, label, parent_label, path, link, share_text``: one row per non-null share."""
    return table_of(raw, "share").select("rec_id", "label", "parent_label", "path", F.col("node.link").alias("link"), F.col("node.share_text").alias("share_text"))


def nested_nodes(telegram: DataFrame, discord: DataFrame, instagram: DataFrame) -> DataFrame:
    """``src, rec_id, table, label, parent_label, path, parent_path``: all child rows of the three raw tables.

    No shuffle anywhere; each table is read once; rows without an id keep null.
    """
    columns = ["rec_id", "table", "label", "parent_label", "path", "parent_path"]
    t = telegram_text_table(telegram).withColumns({"table": F.regexp_replace("path", r"\[\d+\]", ""), "label": F.col("dewey"), "parent_label": _parent_label(F.col("dewey"))})
    part = lambda src, d: d.select(F.lit(src).alias("src"), *columns)
    return part("telegram_raw", t).unionByName(part("discord_raw", nodes(discord, "author", "attachments"))).unionByName(part("instagram_raw", nodes(instagram, "share")))
