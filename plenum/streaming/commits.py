"""A commit log for what a stream writes, batch by batch.

A batch writes its files into folders of its own and then, as its last act, one
record: the batch, the fingerprint of the run, and every file with its size.
Readers take the files of the records and nothing else, so all tables of a batch
appear together or not at all, and what a killed attempt left behind is never
seen.  A batch that has a record is not written again.

A fold is a record, too: it replaces the files of some tables up to a batch by a
new set, and carries the rest of the list on.  Readers start from the newest fold,
so neither the log nor a folded table grows with the number of batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class StoredFile:
    table: str
    batch: int
    path: str
    bytes: int


@dataclass(frozen=True)
class State:
    """What the log says: the last batch, the batch of the newest fold, the live files."""

    last: int
    folded: int
    files: tuple[StoredFile, ...]


def run_key(fingerprint: str) -> str:
    return sha256(fingerprint.encode()).hexdigest()[:16]


class BatchLog:
    """The log of one run below ``target``; ``tables`` names the folder of each table."""

    def __init__(self, spark: SparkSession, target: str, fingerprint: str, tables: dict[str, str]):
        self.spark, self.fingerprint, self.tables = spark, fingerprint, tables
        self.run = run_key(fingerprint)
        self.folder = f"{target.rstrip('/')}/_commits/{self.run}"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ------------------------------------------------------------- the file system

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, folder: str) -> list[tuple[str, int]]:
        """(path, bytes) of the files right below a folder and its partition folders."""
        path = self._path(folder)
        fs = path.getFileSystem(self._conf)
        if not fs.exists(path):
            return []
        found, listing = [], fs.listFiles(path, True)
        while listing.hasNext():
            status = listing.next()
            if not status.getPath().getName().startswith(("_", ".")):
                found.append((status.getPath().toString(), int(status.getLen())))
        return sorted(found)

    def _read(self, path: str) -> list[dict]:
        where = self._path(path)
        stream = where.getFileSystem(self._conf).open(where)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [json.loads(line) for line in text.splitlines()]

    def _publish(self, name: str, lines: list[dict]) -> bool:
        """Put a record into the log, whole or not at all; False if it was there."""
        final, hidden = self._path(f"{self.folder}/{name}"), self._path(f"{self.folder}/.{name}-{uuid.uuid4().hex[:8]}")
        fs = final.getFileSystem(self._conf)
        if fs.exists(final):
            return False
        fs.mkdirs(final.getParent())
        out = fs.create(hidden, False)
        out.write(bytearray("".join(json.dumps(line, sort_keys=True) + "\n" for line in lines).encode()))
        out.close()
        if not fs.rename(hidden, final):
            fs.delete(hidden, False)
            if not fs.exists(final):
                raise OSError(f"cannot write the record {name}")
            return False
        return True

    # ------------------------------------------------------------------ the log

    def _names(self) -> list[str]:
        return [path.rsplit("/", 1)[-1] for path, _ in self._list(self.folder)]

    def state(self) -> State:
        """The newest fold and the records after it."""
        names = self._names()
        folds = sorted(int(n[5:-5]) for n in names if n.startswith("fold-"))
        batches = sorted(int(n[6:-5]) for n in names if n.startswith("batch-"))
        folded = folds[-1] if folds else -1
        records = [self._read(f"{self.folder}/fold-{folded:012d}.json")] if folds else []
        records += [self._read(f"{self.folder}/batch-{b:012d}.json") for b in batches if b > folded]
        files = []
        for head, *listed in records:
            if head["fingerprint"] != self.fingerprint:
                raise RuntimeError(f"a record below {self.folder} is of another run")
            files += [StoredFile(f["table"], f["batch"], f["path"], f["bytes"]) for f in listed]
        return State(max([folded, *batches], default=-1), folded, tuple(files))

    def has(self, batch: int) -> bool:
        names = self._names()
        return f"batch-{batch:012d}.json" in names or any(n.startswith("fold-") and batch <= int(n[5:-5]) for n in names)

    def _write(self, table: str, rows: DataFrame, batch: int, partition: list[str] | None) -> tuple[list[dict], int]:
        """Write one table of a batch into a fresh folder; its files and number of rows."""
        folder, seen = f"{self.tables[table]}/attempt={batch}-{self.run}-{uuid.uuid4().hex[:8]}", Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write
        (writer.partitionBy(*partition) if partition else writer).parquet(folder)
        files = [{"table": table, "batch": batch, "path": path, "bytes": size} for path, size in self._list(folder)]
        return files, int(seen.get["rows"])

    def commit(self, batch: int, tables: dict[str, DataFrame], partition: dict[str, list[str]] | None = None) -> bool:
        """Write all tables of a batch, then its record.  False, and nothing written, if the batch has one already."""
        if self.has(batch):
            return False
        files, rows = [], {}
        for table, df in tables.items():
            listed, rows[table] = self._write(table, df, batch, (partition or {}).get(table))
            files += listed
        return self._publish(f"batch-{batch:012d}.json", [{"batch": batch, "fingerprint": self.fingerprint, "rows": rows}, *files])

    def fold(self, tables: dict[str, DataFrame], partition: dict[str, list[str]] | None = None) -> bool:
        """Replace all files of ``tables`` up to the last batch by the given rows; other tables keep theirs.

        Until the record is there the old files count, so a killed fold loses nothing.
        """
        state = self.state()
        if state.last == state.folded:
            return False
        files = [{"table": f.table, "batch": f.batch, "path": f.path, "bytes": f.bytes} for f in state.files if f.table not in tables]
        rows = {}
        for table, df in tables.items():
            listed, rows[table] = self._write(table, df, state.last, (partition or {}).get(table))
            files += listed
        head = {"batch": state.last, "fingerprint": self.fingerprint, "rows": rows}
        return self._publish(f"fold-{state.last:012d}.json", [head, *files])

    def forget(self) -> int:
        """Delete what no reader needs: records before the newest fold and files that neither it nor the fold before lists.

        Files of the fold before stay for readers that are still at it.  Returns the number of deleted folders.
        """
        names = self._names()
        folds = sorted(n for n in names if n.startswith("fold-"))
        if len(folds) < 2:
            return 0
        newest, gone = int(folds[-1][5:-5]), 0
        listed = [f["path"] for n in folds[-2:] for f in self._read(f"{self.folder}/{n}")[1:]] + [f.path for f in self.state().files]
        kept = {attempt for path in listed for attempt in path.split("/") if attempt.startswith("attempt=")}
        for folder in set(self.tables.values()):
            where = self._path(folder)
            fs = where.getFileSystem(self._conf)
            for status in fs.listStatus(where) if fs.exists(where) else ():
                name = status.getPath().getName()
                batch, _, rest = name.removeprefix("attempt=").partition("-")
                if rest.startswith(f"{self.run}-") and name not in kept and int(batch) <= newest:
                    gone += bool(fs.delete(status.getPath(), True))
        for name in names:
            if name.startswith("batch-") and int(name[6:-5]) <= newest or name in folds[:-2]:
                record = self._path(f"{self.folder}/{name}")
                record.getFileSystem(self._conf).delete(record, False)
        return gone

    # ------------------------------------------------------------------ reading

    def manifest(self) -> DataFrame:
        """(batch, kind, table, rows, files, bytes) of the records in the log; the kind is batch or fold."""
        listed = []
        for name in self._names():
            head, *files = self._read(f"{self.folder}/{name}")
            for table, rows in head["rows"].items():
                own = [f["bytes"] for f in files if f["table"] == table]
                listed.append((head["batch"], name.split("-")[0], table, rows, len(own), sum(own)))
        return self.spark.createDataFrame(listed, "batch bigint, kind string, table string, rows bigint, files bigint, bytes bigint")

    def damaged(self) -> list[str]:
        """Listed files that are missing or have another size."""
        state, found = self.state(), {}
        for folder in {f.path.rsplit("/", 1)[0] for f in state.files}:
            found |= dict(self._list(folder))
        return sorted(f.path for f in state.files if found.get(f.path) != f.bytes)

    def rows(self, table: str, schema: T.StructType, wanted: Callable[[StoredFile], bool] | None = None) -> DataFrame:
        """Rows of a table, from listed files alone; ``wanted`` leaves files out before anything is read."""
        damaged = self.damaged()
        if damaged:
            raise RuntimeError(f"files of committed batches are missing or changed: {damaged[:5]}")
        paths = [f.path for f in self.state().files if f.table == table and (wanted is None or wanted(f))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)
