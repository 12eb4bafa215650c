"""Case files, skill documents and growing transcripts as Spark data sources.

``spark.read.format("cases")`` and ``format("skills")`` plan partitions over many small files by bytes: one task takes files up to ``partitionBytes``, each
counted with ``openBytes`` more. ``badFiles`` says what a file that cannot be read as asked becomes: ``error`` (the default) ends the query with its name,
``row`` gives a row with ``error`` set, ``drop`` leaves it out.

``spark.readStream.format("lines")`` reads files that grow: each batch has the lines that were completed since the batch before. A line belongs to the batch
in which its end lies, so half-written lines wait, and a batch that is read again has the same lines. Files may only be appended to.

Files are reached by Arrow's file systems (local, HDFS, S3, GCS); a store that only Spark reads is read by ``documents.load_cases``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PARTITION_BYTES, OPEN_BYTES = 32 << 20, 1 << 16
BAD = ("error", "row", "drop")


class BadFileError(ValueError):
    """A file that is not what its format asks for."""


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def _listed(path: str, suffix: str) -> tuple[str, list[fs.FileInfo]]:
    """(base, files) at a file or below a folder, in the order of their path's parts."""
    store, plain = _store(path)
    info = store.get_file_info(plain)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return plain.rsplit("/", 1)[0] + "/", [info]
    base = plain.rstrip("/") + "/"
    found = [f for f in store.get_file_info(fs.FileSelector(plain, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffix)]
    return base, sorted(found, key=lambda f: f.path.split("/"))


def planned(sizes: list[int], most: int, each: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring files whose bytes, each with ``each`` more, stay within ``most``; a larger file is alone."""
    out, first, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size + each > most:
            out.append((first, i))
            first, total = i, 0
        total += size + each
    return [*out, (first, len(sizes))] if sizes else []


@dataclass
class Files(InputPartition):
    base: str
    names: list[str]
    beside: list[bool]


class _WholeFiles(DataSourceReader):
    """One row for each file."""

    suffix = ""

    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.bad = options.get("badfiles", options.get("badFiles", "error"))
        if not self.path or self.bad not in BAD:
            raise ValueError(f"a path is needed, and badFiles is one of {', '.join(BAD)}")
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.each = int(options.get("openbytes", options.get("openBytes", OPEN_BYTES)))

    def take(self, files: list[fs.FileInfo]) -> tuple[list[fs.FileInfo], list[bool]]:
        return files, [False] * len(files)

    def partitions(self) -> list[Files]:
        base, files = _listed(self.path, self.suffix)
        files, beside = self.take(files)
        return [Files(base, [f.path for f in files[i:j]], beside[i:j]) for i, j in planned([f.size or 0 for f in files], self.most, self.each)] or [Files(base, [], [])]

    def row(self, source: str, content: str | None, beside: bool, error: str | None) -> tuple:
        raise NotImplementedError

    def problem(self, content: str) -> str | None:
        return None

    def read(self, partition: Files) -> Iterator[tuple]:
        store = _store(self.path)[0]
        for name, beside in zip(partition.names, partition.beside):
            source, content, error = name.removeprefix(partition.base), None, None
            try:
                with store.open_input_stream(name) as file:
                    content = file.read().decode("utf-8")
                error = self.problem(content)
            except UnicodeDecodeError as e:
                error = f"not UTF-8 at byte {e.start}"
            except OSError as e:
                error = f"cannot be read: {e}"
            if error and self.bad == "error":
                raise BadFileError(f"{source}: {error}")
            if not error or self.bad == "row":
                yield self.row(source, content, beside, error)


class _CaseReader(_WholeFiles):
    suffix = ".yaml"

    def problem(self, content: str) -> str | None:
        from assayframe.sources.documents import parse_case

        self.parsed = parse_case(content)
        return self.parsed["error"] or _missing(self.parsed["keys"])

    def row(self, source, content, beside, error):
        from assayframe.sources.documents import CASE_FIELDS, parse_case

        fields = parse_case("null") if content is None else self.parsed
        return (source, content, *[error if f.name == "error" else _value(fields[f.name]) for f in CASE_FIELDS.fields])


def _value(x):
    """Dicts of assertions as tuples, as rows are given."""
    return [(a and (a["type"], a["value"])) if isinstance(a, dict) or a is None else a for a in x] if isinstance(x, list) else x


def _missing(keys: list[str]) -> str | None:
    from assayframe.operators.samples import REQUIRED

    gone = sorted(set(REQUIRED) - set(keys))
    return f"missing required fields: {', '.join(gone)}" if gone else None


class CaseFiles(DataSource):
    """``cases``: one parsed case for each .yaml file."""

    @classmethod
    def name(cls) -> str:
        return "cases"

    def schema(self) -> T.StructType:
        from assayframe.sources.documents import CASE_FIELDS

        return T.StructType([T.StructField("source", T.StringType()), T.StructField("content", T.StringType()), *CASE_FIELDS.fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _CaseReader(self.options)


class _SkillReader(_WholeFiles):
    suffix = ".md"

    def take(self, files):
        """Documents, and whether a README.md lies beside each."""
        folders = {f.path.rsplit("/", 1)[0] for f in files if f.base_name == "README.md"}
        own = [f for f in files if f.base_name != "README.md"]
        return own, [f.path.rsplit("/", 1)[0] in folders for f in own]

    def row(self, source, content, beside, error):
        return source, content, beside, error


class SkillFiles(DataSource):
    """``skills``: one document for each .md file but README.md."""

    @classmethod
    def name(cls) -> str:
        return "skills"

    def schema(self) -> str:
        return "path string, content string, has_readme boolean, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SkillReader(self.options)


@dataclass
class Bytes(InputPartition):
    name: str
    start: int
    end: int


#: bytes read at a time where a line's start is looked for
_BACK = 1 << 16


class _LineReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options.get("path", ""), options.get("suffix", ".jsonl")
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        base, files = _listed(self.path, self.suffix)
        return {f.path.removeprefix(base): f.size for f in files}

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        grown = [(name, start.get(name, 0), size) for name, size in sorted(end.items()) if size > start.get(name, 0)]
        return [Bytes(name, a, min(a + self.most, size)) for name, first, size in grown for a in range(first, size, self.most)] or [Bytes("", 0, 0)]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        """Lines whose end lies in the range, with the place of their first byte."""
        if not partition.name:
            return
        store, plain = _store(self.path)
        whole = plain if store.get_file_info(plain).type == fs.FileType.File else f"{plain.rstrip('/')}/{partition.name}"
        with store.open_input_file(whole) as file:
            at = begin = partition.start
            while begin > 0:  # back to the line that the range begins in
                low = max(0, begin - _BACK)
                cut = file.read_at(begin - low, low).rfind(b"\n")
                begin = low if cut < 0 else low + cut + 1
                if cut >= 0:
                    break
            data = file.read_at(partition.end - begin, begin)
        places, lines = [], []
        here = 0
        while (stop := data.find(b"\n", max(here, at - begin))) >= 0:
            places.append(begin + here)
            lines.append(data[here:stop].removesuffix(b"\r").decode("utf-8", "replace"))
            here = stop + 1
        yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "line_no", "raw"])


class GrowingLines(DataSource):
    """``lines``: completed lines of files that are appended to."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "file string, line_no bigint, raw string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _LineReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (CaseFiles, SkillFiles, GrowingLines):
        spark.dataSource.register(source)

