"""Tables of a stream that become visible together, batch by batch, and their compaction.

A micro-batch writes each of its tables to a folder of its own and then one small commit file that names them.
Readers take the folders of committed batches only, so of a batch they see all tables or none, whatever write failed;
a retried batch overwrites its own folders before it commits.  ``compact`` rewrites what a table's committed batches hold
into one base folder and commits that; the folders it replaces stay readable for those who have opened them until
``vacuum`` deletes them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ingest import scratch_path

_LOG = "_commits"


class BatchCommits:
    """Commit files of the tables under ``root``: ``batch-<id>`` per micro-batch, ``base-<table>-<id>`` per compaction
    (its folder stands for the table's rows of all batches up to ``id``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- commit files -----------------------------------------------------------------------------

    def _put(self, name: str, content: dict) -> None:
        """A commit file appears whole: it is written aside and renamed."""
        aside, place = (self._path(f"{self.root}/{_LOG}/{n}") for n in (f".{name}.tmp", name))
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        self._fs.delete(place, False)  # of an earlier try of the same batch
        if not self._fs.rename(aside, place):
            raise OSError(f"commit {name} could not be renamed")

    def _names(self) -> list[str]:
        folder = self._path(f"{self.root}/{_LOG}")
        if not self._fs.exists(folder):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(folder) if not s.getPath().getName().startswith(".")]

    def _content(self, name: str) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/{_LOG}/{name}").first()[0])

    def batches(self, table: str | None = None) -> list[int]:
        """Ids of the committed batches (that have ``table``): one short line each."""
        if not any(n.startswith("batch-") for n in self._names()):
            return []
        lines = self.spark.read.schema("tables array<string>, id long").json(f"{self.root}/{_LOG}/batch-*")
        return sorted(r[0] for r in (lines.filter(F.array_contains("tables", table)) if table else lines).select("id").collect())

    def base(self, table: str) -> tuple[int, str | None]:
        """Last batch that the newest compaction of ``table`` covers, and its folder."""
        upto = [int(n.rsplit("-", 1)[1]) for n in self._names() if n.startswith(f"base-{table}-")]
        return (max(upto), self._content(f"base-{table}-{max(upto)}")["folder"]) if upto else (-1, None)

    # -- tables -----------------------------------------------------------------------------------

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")
        self._put(f"batch-{batch_id}", {"id": batch_id, "tables": sorted(tables)})

    def folders(self, table: str) -> list[str]:
        upto, base = self.base(table)
        return [base] * (base is not None) + [f"{self.root}/{table}/batch_id={b}" for b in self.batches(table) if b > upto]

    def read(self, table: str) -> DataFrame:
        """Rows of ``table`` in all committed batches."""
        folders = self.folders(table)
        if not folders:
            raise ValueError(f"no batch of {table} is committed in {self.root}")
        return self.spark.read.parquet(*folders)

    def compact(self, table: str, keep: Column | None = None) -> int:
        """Rewrite the committed rows of ``table`` for which ``keep`` holds as its new base; returns the last batch covered.

        Batches that commit meanwhile are not covered and stay as they are; without a new batch since the last compaction
        the base is rewritten (rows may have expired).  A compaction that fails commits nothing."""
        batches, (upto, base) = self.batches(table), self.base(table)
        last = max(batches, default=upto)
        rows = self.spark.read.parquet(*[base] * (base is not None), *[f"{self.root}/{table}/batch_id={b}" for b in batches if b > upto])
        folder = f"{self.root}/{table}/base-{last}-{scratch_path(self.spark, 'x').rsplit('-', 1)[1]}"
        (rows.filter(keep) if keep is not None else rows).write.parquet(folder)
        self._put(f"base-{table}-{last}", {"folder": folder})
        return last

    def vacuum(self, table: str) -> int:
        """Delete the folders of ``table`` that no reader opens any more; returns how many there were."""
        live = {f.rsplit("/", 1)[1] for f in self.folders(table)}
        upto, base = self.base(table)
        removed = 0
        for s in self._fs.listStatus(self._path(f"{self.root}/{table}")):
            name = s.getPath().getName()
            replaced = name.startswith("base-") or (name.startswith("batch_id=") and int(name.split("=")[1]) <= upto)
            if base is not None and replaced and name not in live:
                removed += self._fs.delete(s.getPath(), True)
        return removed
