"""Text tables of the analysis tools as a Spark data source, in batch and as a stream.

``register(spark)`` makes two formats known:

* ``meshquill_table``: the rows of PDF, spectrum, structure function and evolution tables, as double columns beside file and offset (of the
  line in its file, which orders rows). Each file's own header names its columns; files may have different ones, and a column that a file lacks
  is null there. Large files are read in pieces of ``split`` bytes. As a stream it follows files that grow and files that appear.
* ``meshquill_header``: file, layout, name, value, sigma: what stands above the table, a row with null name if nothing does.

Layouts are told by the first lines: pairs of a label and a line of a number (and its deviation) come before the line of column names, which
is the last line before the numbers that does not hold numbers alone. ``pdf`` has moments on top, ``decomposed_spectrum`` sums, ``spectrum`` a column
of bin indices first and nothing on top, and ``table`` is all else. The option ``path`` takes a file, a folder or a pattern; a path with a scheme goes through
Arrow's file systems, so that executors read what they are told and nothing passes through the driver.
"""

from __future__ import annotations

import fnmatch
import glob
import os
import posixpath
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .text import MARKER

HEAD_BYTES, HEAD_LINES, SPLIT, ROWS = 1 << 16, 64, 64 << 20, 10_000
#: The first words of the labels above a PDF, and the name of a spectrum's first column.
MOMENTS = {"mean", "rms", "skew", "kurt", "sigma"}
BIN_INDEX = "#00_BinIndex"


def file_system(path: str):
    """A file system and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """The files (name, size) that a path, a folder or a pattern names, in order; names that begin with . or _ are left out."""
    system, inside = file_system(path)
    if isinstance(system, pafs.LocalFileSystem) and "://" not in path:
        names = sorted(glob.glob(os.path.join(inside, "*") if os.path.isdir(inside) else inside))
        found = [(n, os.path.getsize(n)) for n in names if os.path.isfile(n)]
    else:
        scheme = path[: len(path) - len(inside.lstrip("/"))]
        folder, pattern = (inside, "*") if system.get_file_info(inside).type == pafs.FileType.Directory else posixpath.split(inside)
        infos = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        found = sorted((scheme + i.path.lstrip("/"), i.size) for i in infos if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, pattern))
    return [(n, s) for n, s in found if posixpath.basename(n)[:1] not in (".", "_")]


def numbers(line: str) -> list[float] | None:
    """The numbers of a line that holds nothing else; None for other lines and blank ones."""
    try:
        return [float(x) for x in line.split()] or None
    except ValueError:
        return None


@dataclass
class Head:
    """What stands above a file's rows."""

    names: list[str]
    values: list[tuple[str, float, float | None]]
    layout: str


def head_of(lines: list[str]) -> Head:
    """The head by a file's first lines. A table begins where two lines of numbers follow each other, or one of more than two does."""
    told = [numbers(x) for x in lines]
    rows = [k for k, v in enumerate(told) if v]
    first = next((k for k in rows if len(told[k]) > 2 or (k + 1 < len(told) and told[k + 1])), rows[-1] if rows else len(lines))
    named = next((k for k in range(first - 1, -1, -1) if told[k] is None and lines[k].strip()), None)
    if named is None and first == len(lines):  # names and no rows yet
        named = next((k for k, x in enumerate(lines) if x.strip()), None)
    if named is None:
        return Head([f"c{k}" for k in range(len(told[first]) if rows else 0)], [], "table")
    values, label = [], None
    for k in range(named):
        if told[k] is None and lines[k].strip():
            label = lines[k].strip()
        elif told[k] and label:
            values.append((label, told[k][0], told[k][1] if len(told[k]) > 1 else None))
            label = None
    names = lines[named].split()
    layout = "pdf" if values and values[0][0].split()[0] in MOMENTS else "decomposed_spectrum" if values else "spectrum" if BIN_INDEX in names else "table"
    return Head(names, values, layout)


def read_head(path: str) -> Head:
    system, inside = file_system(path)
    with system.open_input_file(inside) as f:
        start = f.read(HEAD_BYTES).decode("utf-8", "replace")
    lines = start.split("\n")
    return head_of((lines if len(start) < HEAD_BYTES else lines[:-1])[:HEAD_LINES])


def distinct(names: list[str]) -> list[str]:
    """Column names, the second and later ones of a kind with a number behind; names of our own columns likewise."""
    seen: dict[str, int] = {"file": 1, "offset": 1}
    out = []
    for n in names:
        key = n.lower()
        seen[key] = seen.get(key, 0) + 1
        out.append(n if seen[key] == 1 else f"{n}_{seen[key]}")
    return out


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


def lines_of(piece: Piece):
    """offset, line, whether a restart marker stands before it, of the lines that begin in a piece."""
    system, inside = file_system(piece.path)
    with system.open_input_file(inside) as f:
        at = max(0, piece.start - HEAD_BYTES)
        f.seek(at)
        back = f.read(piece.start - at)
        if back and not back.endswith(b"\n"):  # inside a line: it belongs to the piece before
            begin = back.rfind(b"\n") + 1
            rest = _line(f)
            before, at = back[begin:] + rest, piece.start + len(rest)
        else:
            before, at = back[back.rstrip(b"\n").rfind(b"\n") + 1 :], piece.start
        marked = before.strip() == MARKER.encode()
        f.seek(at)
        held = b""
        while at < piece.end:
            block = f.read(1 << 20)
            parts = (held + block).split(b"\n")
            held = parts.pop() if block else b""
            for line in parts:
                if at >= piece.end:
                    return
                text = line.decode("utf-8", "replace")
                yield at, text, marked
                marked, at = text.strip() == MARKER, at + len(line) + 1
            if not block:
                return


def _line(f) -> bytes:
    """The rest of a line, its end included."""
    out = b""
    while True:
        block = f.read(1 << 12)
        end = block.find(b"\n")
        out += block if end < 0 else block[: end + 1]
        if end >= 0 or not block:
            return out


def rows_of(piece: Piece, schema: StructType):
    """Batches of a piece's rows: lines of as many numbers as the file has columns, or more; those after a restart marker not at time 0."""
    names = distinct(read_head(piece.path).names)
    wanted = [f.name for f in schema.fields if f.name not in ("file", "offset")]
    at = {n: k for k, n in enumerate(names)}
    held: list[tuple] = []

    def batch():
        columns = [pa.array([piece.path] * len(held), pa.string()), pa.array([r[0] for r in held], pa.int64())]
        columns += [pa.array([r[1][at[n]] for r in held] if n in at else [None] * len(held), pa.float64()) for n in wanted]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["file", "offset", *wanted])

    heads = 0 if piece.start else len(read_head(piece.path).values)
    for offset, line, marked in lines_of(piece):
        row = numbers(line)
        if heads and row and len(row) <= 2 and len(row) != len(names):  # a number above the table
            heads -= 1
            continue
        if row is None or len(row) < len(names) or not names or (marked and row[0] == 0):
            continue
        held.append((offset, row))
        if len(held) >= ROWS:
            yield batch()
    if held:
        yield batch()


def pieces_of(path: str, start: int, end: int, split: int) -> list[Piece]:
    return [Piece(path, s, min(s + split, end)) for s in range(start, end, split)]


class TableReader(DataSourceReader):
    def __init__(self, path: str, split: int, schema: StructType) -> None:
        self.path, self.split, self.schema = path, split, schema

    def partitions(self):
        return [p for name, size in files_of(self.path) for p in pieces_of(name, 0, size, self.split)] or [Piece("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from rows_of(partition, self.schema)


class TableStream(DataSourceStreamReader):
    """Offsets are the bytes read of each file, up to the last whole line."""

    def __init__(self, path: str, split: int, schema: StructType) -> None:
        self.path, self.split, self.schema = path, split, schema

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        return {name: whole_lines(name, size) for name, size in files_of(self.path)}

    def partitions(self, start, end):
        return [p for name, to in end.items() for p in pieces_of(name, start.get(name, 0), to, self.split)] or [Piece("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from rows_of(partition, self.schema)


def whole_lines(path: str, size: int) -> int:
    """The bytes up to the end of the last whole line."""
    system, inside = file_system(path)
    with system.open_input_file(inside) as f:
        at = size
        while at > 0:
            begin = max(0, at - HEAD_BYTES)
            f.seek(begin)
            end = f.read(at - begin).rfind(b"\n")
            if end >= 0:
                return begin + end + 1
            at = begin
    return 0


class Tables(DataSource):
    """Rows of text tables."""

    @classmethod
    def name(cls):
        return "meshquill_table"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("the option path names the files")
        return self.options["path"]

    def schema(self):
        names: dict[str, None] = {}
        for file, _ in files_of(self._path()):
            names.update(dict.fromkeys(distinct(read_head(file).names)))
        return StructType([StructField("file", StringType()), StructField("offset", LongType()), *(StructField(n, DoubleType()) for n in names)])

    def reader(self, schema):
        return TableReader(self._path(), int(self.options.get("split", SPLIT)), schema)

    def streamReader(self, schema):  # noqa: N802
        return TableStream(self._path(), int(self.options.get("split", SPLIT)), schema)


class HeaderReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        return [Piece(name, 0, size) for name, size in files_of(self.path)] or [Piece("", 0, 0)]

    def read(self, partition):
        if partition.path:
            head = read_head(partition.path)
            for name, value, sigma in head.values or [(None, None, None)]:
                yield partition.path, head.layout, name, value, sigma


class Headers(Tables):
    """What stands above text tables."""

    @classmethod
    def name(cls):
        return "meshquill_header"

    def schema(self):
        return "file string, layout string, name string, value double, sigma double"

    def reader(self, schema):
        return HeaderReader(self._path())

    def streamReader(self, schema):  # noqa: N802
        raise NotImplementedError("headers are read in batch")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tables)
    spark.dataSource.register(Headers)
