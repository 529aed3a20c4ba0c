"""Text files by name: each put together from ordered rows by one task, and there only when whole."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that a task gathers before it writes them.
BUFFER_BYTES = 1 << 20
#: Names that the commit compares at a time, and that a listing sends at a time.
COMPARED_NAMES, LISTED_NAMES = 2_000_000, 65_536
#: Bytes of content that are read before they are sent, whole files always.
READ_BYTES = 8 << 20
#: The file of a task's staging folder that has the names of its staged files, which are numbered.
NAMES = "names"
SCHEMA = "file string, part binary"


@dataclass
class Written(WriterCommitMessage):
    """What one task has finished: its staging folder, if it has any file, and how many it has."""

    folder: str | None = None
    count: int = 0


class _Writer(DataSourceArrowWriter):
    """Tasks write below a folder of this run; only the commit of the whole run gives files their names.

    A task that fails or is run twice leaves nothing but staged files of its own, which go with the run's folder. Names stay
    on disk: the commit goes through them one by one, and no message grows with the number of files.
    """

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.staging = f"{root}/.staged-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.staging, exist_ok=True)
        folder, count = f"{self.staging}/{uuid.uuid4().hex}", 0
        name, out, names = None, None, None
        try:
            for batch in batches:
                for file, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if file != name:
                        if out:
                            out.close()
                        if not names:
                            os.mkdir(folder)
                            names = open(f"{folder}/{NAMES}", "w", encoding="ascii")
                        name, out = file, open(f"{folder}/{count}", "wb", buffering=BUFFER_BYTES)
                        names.write(json.dumps(file) + "\n")
                        count += 1
                    out.write(part or b"")
        finally:
            for opened in (out, names):
                if opened:
                    opened.close()
        return Written(folder, count) if count else Written()

    def commit(self, messages: list[Written | None]) -> None:
        done = [message for message in messages if message and message.count]
        twice = self._repeated(done)
        taken = None if self.overwrite else next((n for _, n in self._files(done) if os.path.exists(f"{self.root}/{n}")), None)
        if twice or taken is not None:
            self.abort(messages)
            raise ValueError(f"{twice} files were written by two tasks" if twice else f"there is already {taken}")
        made = None
        for staged, name in self._files(done):
            target = f"{self.root}/{name}"
            if (folder := os.path.dirname(target)) != made:
                os.makedirs(folder, exist_ok=True)
                made = folder
            os.replace(staged, target)
        shutil.rmtree(self.staging, ignore_errors=True)

    def _files(self, done: list[Written]) -> Iterator[tuple[str, str]]:
        """Staged files and their names below the output folder."""
        for task in done:
            with open(f"{task.folder}/{NAMES}", encoding="ascii") as names:
                for k, line in enumerate(names):
                    yield f"{task.folder}/{k}", json.loads(line)

    def _repeated(self, done: list[Written]) -> int:
        """How many names have come before, found by their digests, a part of them at a time."""
        parts, repeated = -(-sum(task.count for task in done) // COMPARED_NAMES), 0
        for part in range(parts):
            held = bytearray()
            for _, name in self._files(done):
                digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
                if int.from_bytes(digest[:4], "little") % parts == part:
                    held += digest
            found = np.frombuffer(held, "<u8").reshape(-1, 2)
            found = found[np.lexsort(found.T)]
            repeated += int((found[1:] == found[:-1]).all(axis=1).sum())
        return repeated

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class NamedFiles(DataSource):
    """``format("named_files")``: rows ``file, part``; the parts of a file must come to one task, in order."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/").removeprefix("file:"), overwrite)


def write_named(rows: DataFrame, root: str, file: Column, part: Column, order: list[str | Column], mode: str = "append") -> None:
    """Write the parts of each ``file`` (a path below ``root``) in order, as UTF-8.

    ``root`` must be a folder that driver and executors share. Files appear when all are whole. ``append`` refuses names that
    are taken, ``overwrite`` replaces the files of these names and leaves others.
    """
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    keys = {f"_order{k}": F.col(o) if isinstance(o, str) else o for k, o in enumerate(order)}
    named = rows.select(file.alias("file"), part.cast("binary").alias("part"), *[c.alias(k) for k, c in keys.items()])
    sorted_rows = named.repartition("file").sortWithinPartitions("file", *keys).select("file", "part")
    sorted_rows.write.format("named_files").mode(mode).option("path", root).save()


def list_named(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``file, length, content`` of the files below ``root`` that hold something; content is only read where it is asked for.

    ``root`` must be a folder that driver and executors share. One task goes through the folders and sends names on as it meets
    them; as many tasks as a shuffle has look at the files and read them. The driver sees no file, whatever their number. Names
    that Spark's readers hide are left out, and ``pattern`` is theirs.
    """
    top = root.rstrip("/").removeprefix("file:")
    if not os.path.isdir(top):
        raise FileNotFoundError(f"there is no folder {root}")
    wanted = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern(), re.DOTALL)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for _ in batches:
            for name in _below(top, ""):
                if wanted.fullmatch(name.rpartition("/")[2]):
                    held.append(name)
                if len(held) >= LISTED_NAMES:
                    yield pa.record_batch([pa.array(held, pa.string())], ["file"])
                    held = []
        yield pa.record_batch([pa.array(held, pa.string())], ["file"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([os.stat(f"{top}/{f}").st_size for f in batch.column(0).to_pylist()], np.int64)
            yield pa.record_batch([batch.column(0), pa.array(lengths)], ["file", "length"]).filter(pa.array(lengths > 0))

    @F.arrow_udf("binary")
    def content(files: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in files:
            held, size = [], 0
            for file in batch.to_pylist():
                with open(f"{top}/{file}", "rb") as opened:
                    held.append(opened.read())
                size += len(held[-1])
                if size >= READ_BYTES:
                    yield pa.array(held, pa.binary())
                    held, size = [], 0
            if held:
                yield pa.array(held, pa.binary())

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = spark.range(0, 1, 1, 1).mapInArrow(names, "file string").repartition(tasks, "file")
    return found.mapInArrow(sizes, "file string, length bigint").withColumn("content", content(F.col("file")))


def _below(top: str, folder: str) -> Iterator[str]:
    """Names below ``top`` of the files in ``folder`` and all folders in it, as they are met."""
    with os.scandir(f"{top}/{folder}") as entries:
        for entry in entries:
            hidden = entry.name.startswith("_") and "=" not in entry.name or entry.name.startswith(".") or entry.name.endswith("._COPYING_")
            if hidden and not entry.name.startswith(("_common_metadata", "_metadata")):
                continue
            if entry.is_dir():
                yield from _below(top, f"{folder}{entry.name}/")
            else:
                yield folder + entry.name
