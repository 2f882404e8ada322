"""Files read by byte ranges, as Python data sources: prefixes of files of any size, and framed lines.

    spark.dataSource.register(files.Prefixes)
    spark.read.format("file_prefixes").option("most", 1 << 20).load("/logs/*.txt")

A task holds a chunk and one line (or prefix) within the limit, whatever the files' sizes: a longer line
is passed over while it is read and gives an error. Files are cut into ranges, and a line is of the
range in which it begins. Paths are folders, files or globs on what pyarrow reads (local and shared
folders, hdfs, s3, gs); names beginning with a dot or underscore are passed over in folders, as Spark does.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vigilake.sources.events import MOST_LINE

#: Fixed value: the most bytes of a file or page that are looked at.
MOST_CONTENT = 1 << 20
#: Bytes that are read at a time, bytes of a range of a file, and bytes of text in a batch.
CHUNK, RANGE, BATCH = 1 << 20, 64 << 20, 8 << 20
#: Files of a partition of prefixes.
FILES = 256


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else "file://" + posixpath.abspath(path))


def listed(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files at a path, in order."""
    system, place = _opened(re.sub(r"^file:/+", "file:///", path))
    stem = place[: m.start()] if (m := re.search(r"[*?\[]", place)) else place
    base = posixpath.dirname(stem) if m else place
    info = system.get_file_info(base)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == arrow_fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(arrow_fs.FileSelector(base, recursive=True))
    scheme = path[: path.index(":") + 1] + "//" if re.match(r"\w+:", path) else ""
    names = re.compile("/".join("[^/]*" if p == "**" else fnmatch.translate(p)[4:-3].replace(".*", "[^/]*") for p in place.split("/")) if m else re.escape(place.rstrip("/")) + r"/.*")
    kept = [f for f in found if f.type == arrow_fs.FileType.File and names.fullmatch(f.path) and not any(p[:1] in "._" for p in f.path[len(base) :].split("/") if p)]
    return sorted((scheme + f.path, f.size) for f in kept)


@dataclass
class Range(InputPartition):
    """Files whole (stop is None), or a range of one."""

    files: list[str]
    start: int = 0
    stop: int | None = None


def whole_characters(data: bytes) -> bytes:
    """Without a character of UTF-8 that is cut at the end."""
    for back in range(1, min(4, len(data)) + 1):
        byte = data[-back]
        if byte & 0xC0 != 0x80:
            size = 1 if byte < 0x80 else 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 1
            return data[:-back] if size > back else data
    return data


class _PrefixReader(DataSourceReader):
    def __init__(self, options: dict[str, Any]) -> None:
        self.path, self.most = options["path"], int(options.get("most", MOST_CONTENT))

    def partitions(self) -> list[Range]:
        names = [f for f, _ in listed(self.path)]
        return [Range(names[i : i + FILES]) for i in range(0, len(names), FILES)] or [Range([])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for file in partition.files:
            system, place = _opened(file)
            with system.open_input_file(place) as f:
                data = f.read(self.most + 1)
            cut = len(data) > self.most
            text = whole_characters(data[: self.most]) if cut else data
            yield file, text.decode("utf-8", "replace"), cut


class Prefixes(DataSource):
    """file, text (at most `most` bytes, never cut inside a character, broken UTF-8 replaced) and cut (whether there is more)."""

    @classmethod
    def name(cls) -> str:
        return "file_prefixes"

    def schema(self) -> str:
        return "file string, text string, cut boolean"

    def reader(self, schema: Any) -> DataSourceReader:
        return _PrefixReader(dict(self.options))


def framed(f: Any, start: int, stop: int, most: int) -> Iterator[tuple[int, bytes | None]]:
    """Offset and bytes, without line break, of the lines that begin from start to before stop; None for one of more than `most` bytes.

    A CR before the line break isn't part of the line, but counts while it is read.
    """
    at = start - 1 if start else 0
    f.seek(at)
    # A line begins at start if a line break is before it; else the first one is of the range before.
    skipping = bool(start)
    begin, held, size = at, [], 0
    while True:
        chunk = f.read(CHUNK)
        if not chunk:
            break
        i = 0
        while i < len(chunk):
            j = chunk.find(b"\n", i)
            end = len(chunk) if j < 0 else j
            if not skipping:
                if begin >= stop:
                    return
                size += end - i
                # One byte more than allowed may be the CR; nothing beyond is held.
                if size <= most + 1:
                    held.append(chunk[i:end])
                else:
                    held.clear()
            if j < 0:
                break
            if not skipping:
                yield begin, _line(held, size, most)
            skipping, begin, held, size = False, at + j + 1, [], 0
            i = j + 1
        at += len(chunk)
    if not skipping and size and begin < stop:
        yield begin, _line(held, size, most)


def _line(held: list[bytes], size: int, most: int) -> bytes | None:
    if size > most + 1:
        return None
    line = b"".join(held)
    line = line[:-1] if line.endswith(b"\r") else line
    return line if len(line) <= most else None


class _LineReader(DataSourceReader):
    def __init__(self, options: dict[str, Any]) -> None:
        self.path, self.most, self.range = options["path"], int(options.get("most", MOST_LINE)), int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        return [Range([f], a, a + self.range) for f, size in listed(self.path) for a in range(0, size, self.range)] or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "line", "error"]
        for file in partition.files:
            system, place = _opened(file)
            with system.open_input_file(place) as f:
                rows: list[tuple] = []
                held = 0
                for offset, line in framed(f, partition.start, partition.stop or 0, self.most):
                    text, error = None, "line too long" if line is None else None
                    if line is not None:
                        try:
                            text = line.decode()
                        except UnicodeDecodeError:
                            error = "no UTF-8"
                    rows.append((file, offset, text, error))
                    held += len(line or b"") + 64
                    if held > BATCH:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class Lines(DataSource):
    """file, offset (the byte at which the line begins), line and error (too long, or no UTF-8) of every line."""

    @classmethod
    def name(cls) -> str:
        return "framed_lines"

    def schema(self) -> str:
        return "file string, offset long, line string, error string"

    def reader(self, schema: Any) -> DataSourceReader:
        return _LineReader(dict(self.options))


def prefixes(spark: SparkSession, path: str, most: int = MOST_CONTENT) -> DataFrame:
    spark.dataSource.register(Prefixes)
    return spark.read.format("file_prefixes").option("most", most).load(path)


def lines(spark: SparkSession, path: str, most: int = MOST_LINE, range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(Lines)
    return spark.read.format("framed_lines").option("most", most).option("range", range_bytes).load(path)
