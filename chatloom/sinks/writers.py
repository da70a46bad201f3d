"""Messages as CSV, JSON and JSON Lines: as columns of lines, strings, single files and distributed folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.config import OutputConfig, OutputFormat
from chatloom.errors import InputOutputError, typed_errors
from chatloom.functions.text import stamp_text

__all__ = ["csv_header", "csv_lines", "json_objects", "jsonl_lines", "format_pieces", "to_csv", "to_json", "to_jsonl", "to_format_string", "write_single", "write_dir"]

#: Bytes of lines put together in one string on their way to the driver.
_BLOCK_BYTES = 1 << 20


def _fields(config: OutputConfig) -> list[tuple[str, Column]]:
    """The CSV columns in their order."""
    out = [("Sender", F.col("sender")), ("Content", F.col("content"))]
    if config.timestamps:
        out.insert(0, ("Timestamp", stamp_text(F.col("timestamp"))))
    if config.ids:
        out.insert(0, ("ID", F.col("id").cast("string")))
    if config.replies:
        out.append(("ReplyTo", F.col("reply_to").cast("string")))
    if config.edited:
        out.append(("Edited", stamp_text(F.col("edited"))))
    return out


def _quoted(c: Column) -> Column:
    return F.when(c.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def csv_header(config: OutputConfig = OutputConfig()) -> str:
    return ";".join(name for name, _ in _fields(config))


def csv_lines(df: DataFrame, config: OutputConfig = OutputConfig()) -> DataFrame:
    """``chat_id, seq, line``: fields between semicolons, quoted only where they need it, nulls empty."""
    return df.select("chat_id", "seq", F.concat_ws(";", *[_quoted(c) for _, c in _fields(config)]).alias("line"))


def _json_pairs(config: OutputConfig) -> list[tuple[str, Column]]:
    out = [("sender", F.col("sender")), ("content", F.col("content"))]
    if config.timestamps:
        out.append(("timestamp", stamp_text(F.col("timestamp"), "json")))
    if config.ids:
        out.append(("id", F.col("id")))
    if config.replies:
        out.append(("reply_to", F.col("reply_to")))
    if config.edited:
        out.append(("edited", stamp_text(F.col("edited"), "json")))
    return out


def _value(c: Column, text: bool) -> Column:
    """A JSON value: to_json of an array without its brackets; control characters escaped in lower case."""
    if not text:
        return c.cast("string")
    raw = F.to_json(F.array(c))
    return F.substring(_lower_escapes(raw), F.lit(2), F.length(raw) - 2)


def _lower_escapes(s: Column) -> Column:
    r"""``\u001F`` as ``\u001f``; only escapes of control characters have this form, and a text's own backslashes are doubled."""
    out = s
    for c in "ABCDEF":
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*\\u00[01]){c}", f"$1{c.lower()}")
    return F.when(s.contains("\\u00"), out).otherwise(s)


def json_objects(df: DataFrame, config: OutputConfig = OutputConfig(), pretty: bool = False) -> DataFrame:
    """``chat_id, seq, line``: objects without null fields, on one line, or on several with two blanks for each level."""
    sep, pad, close = ('": ', "    ", "\n  }") if pretty else ('":', "", "}")
    parts = []
    for name, c in _json_pairs(config):
        v = _value(c, name not in ("id", "reply_to"))
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f'{pad}"{name}{sep}'), v)))
    body = F.array_join(F.array(*parts), ",\n" if pretty else ",")
    return df.select("chat_id", "seq", F.concat(F.lit("  {\n" if pretty else "{"), body, F.lit(close)).alias("line"))


def jsonl_lines(df: DataFrame, config: OutputConfig = OutputConfig()) -> DataFrame:
    return json_objects(df, config)


def _blocks(between: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines in Arrow batches become strings of at most so many bytes, or of one line, put together where they are."""

    def parts(lines):
        if len(lines) > 1 and lines.nbytes > most:
            half = len(lines) // 2
            yield from parts(lines.slice(0, half))
            yield from parts(lines.slice(half))
        elif len(lines):
            yield lines

    def run(batches):
        for b in batches:
            for lines in parts(b.column(0)):
                whole = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
                yield pa.RecordBatch.from_arrays([pc.binary_join(whole, pa.scalar(between, lines.type))], ["block"])

    return run


def format_pieces(df: DataFrame, form: OutputFormat | str, config: OutputConfig = OutputConfig()) -> Iterator[str]:
    """The whole string in pieces of many messages, in the order of chats and places.

    The driver holds two partitions at once, so that what reads the pieces one by one needs no room for all.
    """
    f = OutputFormat.from_name(form)
    array = f is OutputFormat.JSON
    between = ",\n" if array else "\n"
    lines = csv_lines(df, config) if f is OutputFormat.CSV else json_objects(df, config, pretty=array)
    if f is OutputFormat.CSV:
        yield csv_header(config) + "\n"
    some = False
    with typed_errors():
        for r in lines.orderBy("chat_id", "seq").select("line").mapInArrow(_blocks(between, _BLOCK_BYTES), "block string").toLocalIterator(prefetchPartitions=True):
            yield (between if some else "[\n") + r[0] if array else r[0] + between
            some = True
    if array:
        yield "\n]" if some else "[]"


def to_csv(df: DataFrame, config: OutputConfig = OutputConfig()) -> str:
    """The whole as one string; of no messages, the header."""
    return "".join(format_pieces(df, OutputFormat.CSV, config))


def to_json(df: DataFrame, config: OutputConfig = OutputConfig()) -> str:
    """One array; of no messages ``[]``."""
    return "".join(format_pieces(df, OutputFormat.JSON, config))


def to_jsonl(df: DataFrame, config: OutputConfig = OutputConfig()) -> str:
    """An object per line, each with its line end; of no messages an empty string."""
    return "".join(format_pieces(df, OutputFormat.JSONL, config))


_STRINGS = {OutputFormat.CSV: to_csv, OutputFormat.JSON: to_json, OutputFormat.JSONL: to_jsonl}


def to_format_string(df: DataFrame, form: OutputFormat | str, config: OutputConfig = OutputConfig()) -> str:
    return _STRINGS[OutputFormat.from_name(form)](df, config)


def write_single(df: DataFrame, path: str, form: OutputFormat | str | None = None, config: OutputConfig = OutputConfig()) -> None:
    """One file at *path*, replaced if it exists; the format is the extension's unless given.

    Rows pass through the driver one by one, so a file may be larger than its memory.
    """
    f = OutputFormat.from_name(form) if form else OutputFormat.from_path(path)
    try:
        with typed_errors(), open(path, "w", encoding="utf-8", newline="") as out:
            if f is OutputFormat.CSV:
                out.write(csv_header(config) + "\n")
            lines = csv_lines(df, config) if f is OutputFormat.CSV else json_objects(df, config, pretty=f is OutputFormat.JSON)
            first = True
            for r in lines.orderBy("chat_id", "seq").toLocalIterator():
                if f is OutputFormat.JSON:
                    out.write(("[\n" if first else ",\n") + r["line"])
                else:
                    out.write(r["line"] + "\n")
                first = False
            if f is OutputFormat.JSON:
                out.write("[]" if first else "\n]")
    except OSError as e:
        raise InputOutputError(str(e)) from e


def write_dir(df: DataFrame, path: str, form: OutputFormat | str, config: OutputConfig = OutputConfig(), mode: str = "overwrite") -> None:
    """A folder of files, written by all tasks; each file is sorted by chat and place, CSV files each have the header.

    JSON is written as one object per line here, as no single array can span files.
    """
    with typed_errors():
        _write_dir(df, path, OutputFormat.from_name(form), config, mode)


def _write_dir(df: DataFrame, path: str, f: OutputFormat, config: OutputConfig, mode: str) -> None:
    d = df.repartitionByRange("chat_id", "seq").sortWithinPartitions("chat_id", "seq")
    if f is OutputFormat.CSV:
        d = d.select(*[F.coalesce(c, F.lit("")).alias(n) for n, c in _fields(config)])
        d.write.mode(mode).csv(path, sep=";", header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        jsonl_lines(d, config).select("line").write.mode(mode).text(path)
