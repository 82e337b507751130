"""A data source for tab-separated manifests whose files have different columns.

One scan, or one stream, reads files of any headers: every task takes the header of the file it reads and puts the
file's columns where the result has them. Columns that a file lacks are null, columns that nobody asked for are not converted.
Files are cut into ranges of bytes, small ones are put together, and a task parses a range in Arrow batches. The
driver lists files and opens none.

Values are text. An unquoted empty value is null, a quoted one is empty; quotes inside quotes are doubled; a line is a row. Rows
with fewer values than the header are filled with nulls, surplus values are dropped.

As a stream, every step takes the files that no step before had. Which files a step has is written to the folder given as
``log`` before the step is planned, so a restarted query plans the same step again, and files with old modification
times are found like all others. Hidden files (first letter ``.`` or ``_``) are left out; a file must not change once it is there.
"""

from __future__ import annotations

import csv as plain_csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from uttera.sources.files import opened

NAME = "tsv_manifests"
#: Bytes of a task, and of files that are put together, at most; and how many of them.
RANGE = 64 << 20
TOGETHER = 1000
PIECE = 1 << 20
#: Files whose headers one task reads.
HEADERS = 200


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TsvManifests)
    return spark


def schema_of(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def header_names(line: str) -> list[str]:
    return [n.strip().strip('"').lstrip("﻿") for n in line.split("\t")]


def _first_line(source) -> bytes:
    """The first line with its end; a long one is read piece by piece."""
    held = b""
    while b"\n" not in held:
        piece = source.read(1 << 14)
        if not piece:
            return held
        held += piece
    return held[: held.index(b"\n") + 1]


def _text(line: bytes) -> str:
    return line.decode("utf-8", "replace").rstrip("\r\n")


def headers(spark: SparkSession, paths: list[str]) -> list[str]:
    """First line of each file, read in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for address in batch.column(1).to_pylist():
                system, path = opened(address)
                with system.open_input_file(path) as source:
                    lines.append(_text(_first_line(source)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], names=["at", "header"])

    table = spark.createDataFrame(list(enumerate(paths)), "at long, path string")
    found = table.repartition(max(1, -(-len(paths) // HEADERS)), "at").mapInArrow(run, "at long, header string")
    return [r["header"] for r in sorted(found.collect(), key=lambda r: r["at"])]


class Ranges(InputPartition):
    """Ranges of bytes (address, start, end) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def _listed(roots: list[str]) -> list[tuple[str, int]]:
    """(address, size) of all files below the roots, sorted by address."""
    out = {}
    for root in roots:
        system, path = opened(root if "://" in root or root.startswith("file:") else f"file://{root}")
        before = root[: len(root) - len(path)] if root.endswith(path) else "file://"
        info = system.get_file_info(path)
        found = [info] if info.type == pyarrow.fs.FileType.File else system.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        for f in found:
            inner = f.path[len(path) :].split("/") if f.path != path else [f.base_name]
            if f.type == pyarrow.fs.FileType.File and not any(x.startswith((".", "_")) for x in inner if x):
                out[before + f.path] = f.size
    return sorted(out.items())


def _planned(found: list[tuple[str, int]], size: int) -> list[Ranges]:
    parts, held, total = [], [], 0
    for address, length in found:
        for start in range(0, max(length, 1), size):
            end = min(start + size, length)
            if held and (total + end - start > size or len(held) == TOGETHER):
                parts.append(Ranges(held))
                held, total = [], 0
            held.append((address, start, end))
            total += end - start
    return [*parts, Ranges(held)] if held else parts


def _lines_of(source, start: int, end: int, header: int) -> bytes:
    """The whole lines that begin in [start, end), without the header, which is ``header`` bytes long."""
    if start < max(header, 1):
        source.seek(header)
        at = header
    else:
        source.seek(start - 1)
        at = start - 1
        while True:  # the line that began before this range belongs to the range before
            piece = source.read(PIECE)
            if not piece:
                return b""
            stop = piece.find(b"\n")
            if stop >= 0:
                at += stop + 1
                break
            at += len(piece)
    if at >= end:
        return b""
    source.seek(at)
    parts = [source.read(end - at)]
    while parts[-1] and not parts[-1].endswith(b"\n"):
        piece = source.read(PIECE)
        stop = piece.find(b"\n")
        parts.append(piece[: stop + 1] if stop >= 0 else piece)
    return b"".join(parts)


def _parsed(data: bytes, names: list[str], wanted: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of the wanted columns."""
    odd: list[list[str | None]] = []
    own = [f"{i}" for i in range(len(names))]  # names may repeat; the first one counts
    place = {n: i for i, n in reversed(list(enumerate(names)))}

    def fill(row) -> str:
        values = next(plain_csv.reader(io.StringIO(row.text), delimiter="\t"), [])
        odd.append([v or None for v in values])
        return "skip"

    schema = pa.schema([(n, pa.string()) for n in wanted])
    if data.strip(b"\r\n"):
        table = pa.csv.read_csv(
            pa.py_buffer(data),
            read_options=pa.csv.ReadOptions(column_names=own, use_threads=False, block_size=min(len(data) + 1, (1 << 31) - 1)),
            parse_options=pa.csv.ParseOptions(delimiter="\t", newlines_in_values=False, invalid_row_handler=fill),
            convert_options=pa.csv.ConvertOptions(
                column_types={n: pa.string() for n in own}, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""],
                include_columns=[own[place[n]] for n in wanted if n in place] or own[:1], check_utf8=False,
            ),
        )
        columns = [table[own[place[n]]] if n in place else pa.nulls(len(table), pa.string()) for n in wanted]
        yield from pa.table(columns, schema=schema).to_batches(10_000)
    if odd:
        columns = [[r[place[n]] if n in place and place[n] < len(r) else None for r in odd] for n in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)


class TsvReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = schema.names
        self.roots = json.loads(options["roots"])
        self.size = int(options.get("range", RANGE))

    def partitions(self) -> list[Ranges]:
        return _planned(_listed(self.roots), self.size)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for address, start, end in partition.ranges if partition else []:
            system, path = opened(address)
            with system.open_input_file(path) as source:
                line = _first_line(source)
                data = _lines_of(source, start, end, len(line))
            yield from _parsed(data, header_names(_text(line)), self.columns)


class TsvStream(TsvReader, DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        super().__init__(schema, options)
        self.system, self.log = opened(options["log"] if "://" in options["log"] or options["log"].startswith("file:") else f"file://{options['log']}")
        self.system.create_dir(self.log, recursive=True)

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        steps = self._steps()
        known = {address for step in steps for address, _ in self._files_of(step)}
        new = [f for f in _listed(self.roots) if f[0] not in known]
        last = max(steps, default=0)
        if not new:
            return {"step": last}
        name = f"{self.log}/{last + 1:012d}.json"
        with self.system.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps(new).encode())
        self.system.move(f"{name}.part", name)
        return {"step": last + 1}

    def _steps(self) -> list[int]:
        names = [f.base_name for f in self.system.get_file_info(pyarrow.fs.FileSelector(self.log))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _files_of(self, step: int) -> list[tuple[str, int]]:
        with self.system.open_input_file(f"{self.log}/{step:012d}.json") as source:
            return [tuple(f) for f in json.loads(source.read())]

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        found = [f for step in range(start["step"] + 1, end["step"] + 1) for f in self._files_of(step)]
        return _planned(found, self.size)

    def commit(self, end: dict) -> None:
        """The log is kept: it tells which files are known."""


class TsvManifests(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        raise ValueError("the columns have to be given; manifests.read_mixed_tsv finds them")

    def reader(self, schema: T.StructType) -> TsvReader:
        return TsvReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> TsvStream:
        return TsvStream(schema, self.options)
