"""Records of JSON documents too large for one row, as a data source that reads them piece by piece.

``spark.dataSource.register(JsonArraySource)``, then ``spark.read.format("chat_json_array").load(folder)`` gives
``chat_id, pos, item``; a partition is a file, and at most one record and one block of a file are in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chatloom.errors import BufferOverflowError, UnexpectedEndError

__all__ = ["JsonArraySource", "scan_records"]

BLOCK = 1 << 20


def _structure(read) -> Iterator[str]:
    """The characters that matter: a string as one item, else single ones without white space."""
    block, at = read(BLOCK), 0
    while True:
        if at >= len(block):
            block, at = read(BLOCK), 0
            if not block:
                return
        c = block[at]
        at += 1
        if c != '"':
            yield c
            continue
        parts, escaped = ['"'], False
        while True:
            if at >= len(block):
                block, at = read(BLOCK), 0
                if not block:
                    raise UnexpectedEndError("the document ends inside a string")
            end = block.find('"', at)
            piece = block[at : end + 1] if end >= 0 else block[at:]
            parts.append(piece)
            at += len(piece)
            tail = len(piece.rstrip('"')) if end >= 0 else len(piece)
            body = piece[:tail]
            slashes = len(body) - len(body.rstrip("\\"))
            odd = (slashes + (escaped if slashes == len(body) else 0)) % 2 == 1
            if end >= 0 and not odd:
                break
            escaped = odd if end < 0 else False
        yield "".join(parts)


def scan_records(read, array: str = "messages", largest: int = 10 << 20) -> Iterator[tuple[int, str | None]]:
    """(place, text) of each object in the array *array* at the top level of a document; text null if it is too large.

    *read* is a text file's ``read``. Braces inside strings, escapes and nested objects are followed; a name inside a string
    isn't taken for the array's.
    """
    depth, last, inside, pos = 0, None, False, 0
    record: list[str] | None = None
    size, start = 0, 0
    for c in _structure(read):
        if record is not None:
            size += len(c)
            if size <= largest:
                record.append(c)
        if c in "{[":
            if inside and record is None and c == "{" and depth == 2:
                record, size, start = [c], 1, depth
            if not inside and depth == 1 and c == "[" and last == f'"{array}"':
                inside = True
            depth += 1
        elif c in "}]":
            depth -= 1
            if record is not None and depth == start:
                yield pos, "".join(record) if size <= largest else None
                record, pos = None, pos + 1
            elif inside and depth == 1:
                return
        elif len(c) > 1 or not c.isspace() and c not in ":":
            last = c if len(c) > 1 else None
    if record is not None or inside:
        raise UnexpectedEndError("the document ends inside its records")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _opened(path: str):
    """A file system and a path in it, of a local path or an address that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.array = options.get("array", "messages")
        self.largest = int(options.get("maxrecordsize", 10 << 20))
        self.oversize = options.get("oversize", "skip")

    def partitions(self) -> list[InputPartition]:
        """A partition per file; of a folder all files in it, of a pattern those it fits in its folder."""
        import fnmatch
        import posixpath

        from pyarrow import fs

        system, path = _opened(self.path)
        head = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        folder, pattern = (path.rstrip("/"), "*") if system.get_file_info(path).type == fs.FileType.Directory else posixpath.split(path)
        found = system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
        return [_File(head + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(f.path), pattern)]

    def read(self, partition: _File) -> Iterator[tuple]:
        import io

        system, path = _opened(partition.path)
        with system.open_input_stream(path) as raw, io.TextIOWrapper(io.BufferedReader(raw, BLOCK), encoding="utf-8", newline="") as f:
            for pos, item in scan_records(f.read, self.array, self.largest):
                if item is None and self.oversize == "fail":
                    raise BufferOverflowError(f"record {pos} of {partition.path} is larger than {self.largest} characters")
                yield partition.path, pos, item


class JsonArraySource(DataSource):
    """Options: ``path`` (a file, folder or pattern, local or by an address that pyarrow knows), ``array``,
    ``maxRecordSize``, ``oversize``: ``skip`` gives a larger record as null, ``fail`` ends the read."""

    @classmethod
    def name(cls) -> str:
        return "chat_json_array"

    def schema(self) -> str:
        return "chat_id string, pos bigint, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})
