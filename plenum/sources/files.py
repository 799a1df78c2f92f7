"""Files as rows: listings, digests and lines, read as streams on the executors.

A task lists or opens the files of its rows through the file system that their
address names, and holds one block at a time, however long a file is.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 8 << 20
LINES_AT_ONCE = 4096
LINES_BYTES = 8 << 20
TASKS_A_CORE = 4

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def below(path: Column, root: str) -> Column:
    """A file's path relative to a folder; ``path`` is a URI as Spark reports it, ``root`` absolute."""
    plain = re.sub(_SCHEME, "", root).rstrip("/")
    if not plain.startswith("/"):
        raise ValueError(f"the folder must be absolute: {root}")
    found = F.url_decode(F.replace(F.regexp_replace(path, _SCHEME, ""), F.lit("+"), F.lit("%2B")))
    return F.when(found.startswith(plain + "/"), F.substring(found, len(plain) + 2, F.length(found)))


def _system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the folder in it."""
    plain = re.sub("^file:(//)?", "", root.rstrip("/"))
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(plain)


def _listed(root: str, deep: bool):
    """Entries of the folders of a batch, without hidden ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=deep))
                shown = [i for i in found if not any(part[:1] in "._" for part in i.path[len(base) + 1 :].split("/"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.path[len(base) + 1 :] for i in shown], pa.string()), pa.array([i.size for i in shown], pa.int64()),
                     pa.array([i.type == fs.FileType.Directory for i in shown], pa.bool_())],
                    ["path", "bytes", "folder"],
                )

    return run


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, bytes) of every file, empty ones included; nothing is read.

    Folders right below root are listed by tasks of their own.  Names that begin
    with a dot or an underscore, and what lies below them, are left out.
    """
    kind = "path string, bytes bigint, folder boolean"
    top = spark.createDataFrame([("",)], "path string").mapInArrow(_listed(root, False), kind)
    below_top = top.filter("folder").select("path").repartition("path").mapInArrow(_listed(root, True), kind)
    return top.unionByName(below_top).filter("not folder").select("path", "bytes")


def _open(root: str, path: str):
    """A stream over the bytes of a file as they are stored."""
    system, base = _system(root)
    return system.open_input_stream(f"{base}/{path}", compression=None, buffer_size=BLOCK_BYTES)


def _blocks(root: str, path: str) -> Iterator[bytes]:
    with _open(root, path) as stream:
        while block := stream.read(BLOCK_BYTES):
            yield block


def _spread(paths: DataFrame) -> DataFrame:
    """Files dealt out to tasks, whatever partitions the table of paths has.

    The number of tasks is given: adaptive execution sees how short the paths are, not how
    long the files, and would read all of them in one task.  By a hash of the path, as a
    table that is grouped by the path itself would not be dealt out again.
    """
    return paths.repartition(TASKS_A_CORE * paths.sparkSession.sparkContext.defaultParallelism, F.xxhash64("path"))


def digests(paths: DataFrame, root: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a table of paths below root.

    A file that cannot be opened fails the job.  Null paths are left out; repeated
    ones are digested once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                running, size = hashlib.sha256(), 0
                for block in _blocks(root, path):
                    running.update(block)
                    size += len(block)
                yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "sha256": [running.hexdigest()]})

    wanted = paths.select("path").filter("path is not null").distinct()
    return _spread(wanted).mapInArrow(run, "path string, bytes bigint, sha256 string")


def _unpacked(blocks: Iterator[bytes], packed: bool) -> Iterator[bytes]:
    """Bytes of a gzip file of one or more members, or of a plain one."""
    if not packed:
        yield from blocks
        return
    reader, open_member = zlib.decompressobj(31), False
    for block in blocks:
        while block:
            if reader.eof:
                reader, open_member = zlib.decompressobj(31), False
            # at most a block of text at a time, however well it is packed
            text = reader.decompress(block, BLOCK_BYTES)
            open_member = True
            if text:
                yield text
            block = reader.unused_data if reader.eof else reader.unconsumed_tail
    if open_member and not reader.eof:
        raise EOFError("a gzip file ends early")


def _split(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Lines that end at line feeds, carriage returns or both, without their ends."""
    return (line for lines in _split_blocks(blocks) for line in lines)


def _split_blocks(blocks: Iterator[bytes]) -> Iterator[list[bytes]]:
    """The same, as a list for the lines that end in a block."""
    rest, after_return = [], False
    for block in blocks:
        cut = after_return and block.startswith(b"\n")
        after_return = block.endswith(b"\r")
        block = block[1:] if cut else block  # the second half of a line end
        if b"\r" in block:
            block = block.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        lines = block.split(b"\n")
        rest.append(lines[0])
        if len(lines) > 1:
            lines[0] = b"".join(rest)
            rest = [lines.pop()]
            yield lines
    if last := b"".join(rest):
        yield [last]


def _text(lines: list[bytes]) -> pa.Array:
    """Bytes that are no UTF-8 become U+FFFD."""
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())


def _held(groups: Iterator[list[bytes]]) -> Iterator[list[bytes]]:
    """At most so many lines, or lines of so many bytes, at once; short groups are joined."""
    held, size = [], 0
    for lines in groups:
        for at in range(0, len(lines), LINES_AT_ONCE):
            part = lines[at : at + LINES_AT_ONCE]
            more = sum(map(len, part))
            if held and (len(held) + len(part) > LINES_AT_ONCE or size + more > LINES_BYTES):
                yield held
                held, size = [], 0
            held, size = held + part if held else part, size + more
    if held:
        yield held


def stream_lines(paths: DataFrame, root: str) -> DataFrame:
    """(path, line_no, value) of the lines of the files of a table of paths below root, then the table's other columns.

    Files whose name ends in .gz are unpacked.  Bytes that are no UTF-8 become U+FFFD.
    What else the table says of a file goes with its lines, so that it need not be joined to them.
    """
    more = [c for c in paths.columns if c != "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, path in enumerate(batch.column("path").to_pylist()):
                number = 1
                for lines in _held(_split_blocks(_unpacked(_blocks(root, path), path.endswith(".gz")))):
                    n = len(lines)
                    same = pa.array([row] * n, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("path").take(same), pa.array(range(number, number + n), pa.int64()), _text(lines), *[batch.column(c).take(same) for c in more]],
                        ["path", "line_no", "value", *more],
                    )
                    number += n

    kind = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("value", T.StringType()),
        *[paths.schema[c] for c in more],
    ])
    return _spread(paths.select("path", *more).filter("path is not null")).mapInArrow(run, kind)
