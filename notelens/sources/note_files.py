"""Notes as files: a data source that reads the heads of notes and writes whole ones (SRC-7, SNK-1 of the inventory).

Reading opens each file, takes chunks until the metadata block is closed, and goes on to the next: a query on metadata
costs a chunk or two of each note, whatever their length. Writing puts each row into a file of its own, under a temporary
name first, so a reader sees a whole note or none, and a task that runs again writes the same files once more.

Files are opened by the tasks themselves, through the file systems that Arrow knows by their scheme (local and mounted
folders, HDFS, object stores).
"""

from __future__ import annotations

import codecs
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

LIMIT, CHUNK = 256 << 10, 8 << 10
FILES = 512  # files of one partition
HEADS = "path string, size bigint, mtime timestamp, head string, bytes_read bigint"
ROWS = 500


def _store(root: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return store, path.rstrip("/")


def _complete(data: bytes) -> bool:
    """Whether no more is needed: there is no metadata block, or its closing line is here, with its line end."""
    text = data.removeprefix(codecs.BOM_UTF8).replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if len(text) < 4:
        return False
    return not text.startswith(b"---\n") or b"\n---\n" in text[3:]


def read_head(stream: pa.NativeFile, limit: int = LIMIT, chunk: int = CHUNK) -> tuple[str, int]:
    """The start of a file that holds its whole metadata block, and how many bytes were read for it. A character that
    the limit cuts is left out; bytes that are no text are replaced."""
    data, ended = b"", False
    while len(data) < limit and not ended and not (data and _complete(data)):
        more = stream.read(min(chunk, limit - len(data)))
        ended = not more
        data += more
    return codecs.getincrementaldecoder("utf-8")("replace").decode(data, final=ended), len(data)


@dataclass
class Paths(InputPartition):
    files: list[tuple[str, int, object]]


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.limit, self.chunk = options["path"], int(options.get("limit", LIMIT)), int(options.get("chunk", CHUNK))
        self.prefix = options.get("prefix", "")

    def partitions(self) -> list[Paths]:
        store, root = _store(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        rows = sorted((i.path[len(root) + 1 :], i.size, i.mtime) for i in found if i.type == fs.FileType.File and i.path.lower().endswith(".md"))
        rows = [r for r in rows if r[0].startswith(self.prefix)]
        return [Paths(rows[i : i + FILES]) for i in range(0, len(rows), FILES)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[pa.RecordBatch]:
        store, root = _store(self.root)
        kinds = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("head", pa.string()), ("bytes_read", pa.int64())])
        for at in range(0, len(partition.files), ROWS):
            rows = []
            for path, size, mtime in partition.files[at : at + ROWS]:
                with store.open_input_stream(f"{root}/{path}", buffer_size=None) as stream:
                    head, taken = read_head(stream, self.limit, self.chunk)
                rows.append({"path": path, "size": size, "mtime": mtime, "head": head, "bytes_read": taken})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.root)
        n, made = 0, set()
        for row in iterator:
            parts = row["path"].split("/")
            if any(p in ("", ".", "..") for p in parts) or "\\" in row["path"] or ":" in parts[0]:
                raise ValueError(f"not a path below the folder: {row['path']!r}")
            target, data = f"{root}/{row['path']}", (row["text"] or "").encode()
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            if not self.overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
                with store.open_input_stream(target) as there:
                    if there.read() != data:
                        raise FileExistsError(f"another note is at {row['path']!r}")
                n += 1
                continue
            part = f"{folder}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(data)
            store.move(part, target)
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        """Each file is in place already."""

    def abort(self, messages: list[Written | None]) -> None:
        """Notes that are in place are whole; running the write again completes it."""


class NoteFiles(DataSource):
    """Format ``note_files``: reads heads below ``path`` (options limit, chunk, prefix), writes rows of path and text."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def schema(self) -> str:
        return HEADS

    def reader(self, schema) -> HeadReader:  # noqa: ANN001
        return HeadReader(self.options)

    def writer(self, schema, overwrite: bool) -> FileWriter:  # noqa: ANN001
        return FileWriter(self.options, overwrite)


def read_heads(spark: SparkSession, root: str, limit: int = LIMIT, chunk: int = CHUNK, prefix: str = "") -> DataFrame:
    """SRC-7: path, size, mtime, head and bytes_read of each note below root whose path starts with prefix; bodies stay
    unread, and other files closed."""
    spark.dataSource.register(NoteFiles)
    return spark.read.format("note_files").options(limit=limit, chunk=chunk, prefix=prefix).load(root)


def head_metadata(heads: DataFrame) -> DataFrame:
    """The metadata of heads: as the notes table has it, without anything of the body. A block that the limit cuts is
    unclosed, as in a file that never closes it."""
    from notelens.functions.markdown import meta_of
    from notelens.functions.text import note_date

    parsed = heads.withColumn("m", meta_of("head")).withColumn("v", F.try_parse_json("m.meta"))
    scalar = lambda key: F.nullif(F.trim(F.try_variant_get("v", f"$.{key}", "string")), F.lit(""))
    return parsed.select("path", "size", "mtime", "bytes_read", "m.has_meta", "m.issue", F.col("v").alias("meta"), scalar("type").alias("type"), scalar("status").alias("status"), note_date(scalar("date")).alias("date"))


def write_notes(files: DataFrame, root: str, overwrite: bool = False) -> None:
    """files(path, text) as one file each below root. Without ``overwrite`` a different note that is there already is an
    error, an equal one is not."""
    files.sparkSession.dataSource.register(NoteFiles)
    files.select("path", "text").write.format("note_files").mode("overwrite" if overwrite else "append").save(root)
