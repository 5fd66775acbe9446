"""Intermediate tables in the folder that the whole cluster shares.

Operators that use a result more than once, or iterate, write it as Parquet and
read it back.  That cuts the lineage, so a lost executor costs a re-read instead
of a recomputation, and nothing depends on one machine's disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.sources.shared import fresh_folder


_opened: list[list[Scratch]] = []


@contextmanager
def opened() -> Iterator[list[Scratch]]:
    """Collects the tables of all operator calls inside, for ``release`` once nothing reads them any more."""
    _opened.append([])
    try:
        yield _opened[-1]
    finally:
        _opened.pop()


def release(tables: list[Scratch]) -> None:
    """Delete the tables, and forget them."""
    for scratch in tables:
        scratch.drop(list(scratch.paths))
    tables.clear()


class Scratch:
    """Named tables of one operator call, under a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = fresh_folder(spark, name)
        self.paths: list[str] = []
        self.count = 0
        if _opened:
            _opened[-1].append(self)

    def save(self, frame: DataFrame, name: str, hashes: bool = False) -> DataFrame:
        """The frame, written and read back; hashes: most columns hold few equal values, so no dictionaries are tried."""
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        frame.write.option("parquet.enable.dictionary", "false" if hashes else "true").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, paths: list[str]) -> None:
        """Delete tables that nothing reads any more."""
        for path in paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.paths.remove(path)

    def finish(self, frame: DataFrame) -> DataFrame:
        """The frame as the last table of the call; all others are deleted, as it no longer depends on them."""
        before = list(self.paths)
        result = self.save(frame, "result")
        self.drop(before)
        return result


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores after them as it takes to differ from all columns of the frame."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes that may be broadcast.
BROADCAST = 64 << 20


def small(frame: DataFrame, size: Column | None = None) -> DataFrame:
    """The frame, marked for broadcast if its rows have at most BROADCAST bytes; beyond, joins shuffle it.

    size: the bytes of a row; without it, all columns are taken as numbers of eight bytes.
    """
    rows, total = frame.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    total += rows * 8 * (2 if size is not None else len(frame.columns) + 1)
    return F.broadcast(frame) if total <= BROADCAST else frame
