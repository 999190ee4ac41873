"""Delimited tables inside zip archives, as a data source: ``spark.read.format("zipped_csv")``.

The archives' directories are read when the query is planned. Each member becomes a partition of its own; a member
stored without compression is cut into byte ranges, each owning the lines that begin inside it. Files are opened
through ``pyarrow.fs`` on the driver and in the tasks, so the path must be one that it reaches.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.session import cut_lineage
from tallyframe.sources.schemas import TABLES

MISSING_TEXT = "NA"
SPLIT_BYTES = 64_000_000
BLOCK_BYTES = 8 << 20  # what a task parses at once; also the longest line it can read


def _open(path: str):
    store, own = fs.FileSystem.from_uri(path)
    return store.open_input_file(own)


def archives(path: str) -> list[str]:
    """The archive itself, or all ``.zip`` files of a folder, in order."""
    store, own = fs.FileSystem.from_uri(path)
    if store.get_file_info(own).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(own, recursive=True))
    root = path[: len(path) - len(own)] if path.endswith(own) else path
    names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))
    if not names:
        raise FileNotFoundError(f"no zip archive below {path}")
    return [root + n for n in names]


class _Range(io.RawIOBase):
    """Lines of a stored member that begin in [start, stop) of its bytes, read from an open archive."""

    def __init__(self, file, begin: int, size: int, start: int, stop: int):
        self.file, self.begin, self.size, self.stop, self.done = file, begin, size, stop, False
        self.at = start
        file.seek(begin + max(start - 1, 0))
        if start:
            # The line under way belongs to the range before, unless it ends right here.
            self.at = start - 1
            self._skip_line()

    def readable(self) -> bool:
        return True

    def _skip_line(self) -> None:
        while self.at < self.size:
            piece = self.file.read(min(1 << 16, self.size - self.at))
            end = piece.find(b"\n")
            if end >= 0:
                self.at += end + 1
                self.file.seek(self.begin + self.at)
                return
            self.at += len(piece)

    def readinto(self, out) -> int:
        if self.done or self.at >= self.size:
            return 0
        if self.at >= self.stop:
            self.done = True
            return 0
        piece = self.file.read(min(len(out), self.size - self.at))
        if self.at + len(piece) >= self.stop:
            # The last line of the range ends at the first line break at or after its last byte.
            end = piece.find(b"\n", max(self.stop - 1 - self.at, 0))
            if end >= 0:
                piece, self.done = piece[: end + 1], True
            elif self.at + len(piece) < self.size:
                self.stop = max(self.stop, self.at + len(piece) + 1)
        self.at += len(piece)
        out[: len(piece)] = piece
        return len(piece)


class Member(InputPartition):
    """A member, or the range [start, stop) of a stored one, whose bytes begin at ``begin`` of the archive."""

    def __init__(self, path: str, name: str, begin: int = -1, size: int = 0, start: int = 0, stop: int = 0):
        super().__init__(name)
        self.path, self.name, self.begin, self.size, self.start, self.stop = path, name, begin, size, start, stop


def _data_begin(file, info: zipfile.ZipInfo) -> int:
    file.seek(info.header_offset + 26)
    lengths = file.read(4)
    return info.header_offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little")


def members(path: str, split_bytes: int | None) -> Iterator[Member]:
    """Partitions of one archive; stored members in ranges of ``split_bytes``, if given."""
    with _open(path) as file, zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            if info.is_dir() or not info.file_size:
                continue
            stored = info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1
            if split_bytes and stored and info.file_size > split_bytes:
                begin = _data_begin(file, info)
                for start in range(0, info.file_size, split_bytes):
                    stop = min(start + split_bytes, info.file_size)
                    yield Member(path, info.filename, begin, info.file_size, start, stop)
            else:
                yield Member(path, info.filename)


def header(path: str, delimiter: str = ",") -> list[str]:
    """Column names of the first member of an archive."""
    with _open(path) as file, zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            if not info.is_dir() and info.file_size:
                with archive.open(info) as member:
                    line = io.TextIOWrapper(member, "utf-8-sig", newline=None).readline()
                return pa.csv.read_csv(
                    io.BytesIO(line.encode()), parse_options=pa.csv.ParseOptions(delimiter=delimiter)
                ).column_names
    raise ValueError(f"{path} has no member with a header")


class ZippedCsv(DataSource):
    """Options: ``table`` (a declared table's types; other columns are text), ``delimiter``, ``multiLine`` (quoted fields may
    hold line breaks; members are then never cut) and ``splitBytes``. A schema given to the reader wins, and may leave
    columns out.

    Empty cells and ``NA`` are missing values, quoted or not as for the plain reader; a quoted empty cell is an empty
    text. A line or value that does not fit, a damaged member, or a member whose header differs fails the job.
    The checksum of a member is verified where one task reads it whole.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def _paths(self) -> list[str]:
        return archives(self.options["path"])

    def schema(self) -> T.StructType:
        declared = TABLES.get(self.options.get("table", ""))
        known = {f.name: f.dataType for f in declared} if declared else {}
        names = header(self._paths()[0], self.options.get("delimiter", ","))
        return T.StructType([T.StructField(n, known.get(n, T.StringType()), True) for n in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self._paths(), dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: list[str], options: dict):
        self.fields, self.paths = schema, paths
        self.delimiter = options.get("delimiter", ",")
        self.multi_line = str(options.get("multiline", options.get("multiLine", "false"))).lower() == "true"
        self.split = None if self.multi_line else int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.names = header(paths[0], self.delimiter)
        absent = sorted({f.name for f in schema} - set(self.names))
        if absent:
            raise ValueError(f"the archives have no column(s) {absent}; they have {self.names}")

    def partitions(self) -> list[Member]:
        # One small object per member or range.
        return [m for p in self.paths for m in members(p, self.split)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        with _open(partition.path) as file:
            if partition.begin >= 0:
                lines = _Range(file, partition.begin, partition.size, partition.start, partition.stop)
                yield from self._batches(io.BufferedReader(lines, BLOCK_BYTES), partition.start == 0)
            else:
                with zipfile.ZipFile(file) as archive, archive.open(partition.name) as member:
                    yield from self._batches(member, True)

    def _batches(self, stream, has_header: bool) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.fields)
        if has_header:
            stream = io.BufferedReader(stream) if not isinstance(stream, io.BufferedReader) else stream
            start = stream.peek(3)[:3]
            if start == b"\xef\xbb\xbf":
                stream.read(3)
        elif not stream.peek(1):
            return
        reader = pa.csv.open_csv(
            stream,
            read_options=pa.csv.ReadOptions(
                block_size=BLOCK_BYTES, use_threads=False, column_names=None if has_header else self.names
            ),
            parse_options=pa.csv.ParseOptions(delimiter=self.delimiter, newlines_in_values=self.multi_line),
            convert_options=pa.csv.ConvertOptions(
                column_types={f.name: f.type for f in wanted} | {n: pa.string() for n in self.names if n not in wanted.names},
                null_values=["", MISSING_TEXT],
                strings_can_be_null=True,
                quoted_strings_can_be_null=False,
            ),
        )
        if has_header and reader.schema.names != self.names:
            raise ValueError(f"a member has the columns {reader.schema.names}, the first one {self.names}")
        for batch in reader:
            yield batch.select(wanted.names)


def read_zipped_csv(
    spark: SparkSession, path: str, table: str | None = None, schema: T.StructType | None = None, **options
) -> DataFrame:
    """Tables in a zip archive, or in all archives of a folder; see :class:`ZippedCsv`."""
    spark.dataSource.register(ZippedCsv)
    reader = spark.read.format(ZippedCsv.name()).options(**options)
    if table:
        reader = reader.option("table", table)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_zipped_csv(df: DataFrame, folder: str, stem: str = "part", compress: bool = True) -> DataFrame:
    """Every task writes one archive with one member; returns the archives: path, n_rows.

    Texts are quoted and missing values are empty cells, so that both come back. Each attempt of a task writes a file of its
    own; the result lists those that count.
    """
    wanted = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, n, writer, opened = f"{stem}-{uuid.uuid4().hex}", 0, None, []
        how = zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED
        for batch in batches:
            if writer is None:
                out = store.open_output_stream(posixpath.join(base, f"{name}.zip"), compression=None)
                archive = zipfile.ZipFile(out, "w", how)
                member = archive.open(f"{name}.csv", "w", force_zip64=True)
                writer = pa.csv.CSVWriter(member, wanted, write_options=pa.csv.WriteOptions(quoting_style="all_valid"))
                opened = [writer, member, archive, out]
            writer.write_batch(batch.cast(wanted))
            n += batch.num_rows
        for x in opened:
            x.close()
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.zip"]), pa.array([n])], names=["path", "n_rows"])

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return cut_lineage(df.select(*[F.col(f"`{c}`") for c in df.columns]).mapInArrow(run, "path string, n_rows bigint"))
