"""A versioned table of deliveries with a log: full, delta, backfill and correction, compaction and vacuum.

A version is a folder of data and then, as its commit, a manifest: mode, range of dates, the version that it supersedes and its
rows by date. Full and backfill versions replace every date of their range, also those for which they bring nothing; deltas add;
corrections stay beside what they correct. Each ``every`` versions the present rows are written together under a checkpoint, so a
read opens the checkpoint and at most so many versions after it, however many there were. A version that is known changes
nothing when it comes again. Metadata are a few rows a version; data never pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MODES = ("full", "backfill", "delta", "correction")
REPLACING = ("full", "backfill")
_RUN = "version long, mode string, first_date date, last_date date, supersedes long, rows long"


@dataclass
class TableLog:
    """``path`` in a store that all executors see; ``schema`` of the rows with their date column (a date)."""

    spark: SparkSession
    path: str
    schema: str
    date: str = "as_of_date"
    every: int = 10

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _listed(self, folder: str, kind: str) -> list[int]:
        """Numbers of the committed entries ``kind=n`` of a folder."""
        fs, path = self._fs()
        at = path(f"{self.path}/{folder}")
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{kind}=")]
        return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(path(p, "_SUCCESS")))

    def checkpoint(self) -> int:
        """The last version that a checkpoint holds, -1 without one."""
        return max(self._listed("log", "c"), default=-1)

    def runs(self) -> DataFrame:
        """(version, mode, first_date, last_date, supersedes, rows) of every version, for lineage."""
        done = self.checkpoint()
        new = [f"{self.path}/log/v={v}" for v in self._listed("log", "v") if v > done]
        tables = [self.spark.read.schema(_RUN).parquet(p) for p in ([f"{self.path}/log/c={done}"] if done >= 0 else []) + new]
        return reduce(DataFrame.union, tables) if tables else self.spark.createDataFrame([], _RUN)

    def _after(self) -> tuple[int, list]:
        done = self.checkpoint()
        paths = [f"{self.path}/log/v={v}" for v in self._listed("log", "v") if v > done]
        return done, sorted(self.spark.read.schema(_RUN).parquet(*paths).collect(), key=lambda r: r.version) if paths else []

    def commit(self, version: int, rows: DataFrame, mode: str, dates: tuple | None = None, supersedes: int | None = None) -> bool:
        """Add a version; False if it is there already. Corrections and backfills name the version that they supersede, others must
        not. ``dates`` (first, last) are the range of a full or backfill version, those of its rows if not given; rows outside end
        the run."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        if (mode in ("backfill", "correction")) != (supersedes is not None):
            raise ValueError("backfills and corrections supersede a version, others don't")
        done, after = self._after()
        if version <= done or any(r.version == version for r in after):
            return False
        if version < max((r.version for r in after), default=-1):
            raise ValueError(f"version {version} comes after a later one")
        if supersedes is not None and not (0 <= supersedes <= done or any(r.version == supersedes for r in after)):
            raise ValueError(f"version {supersedes} is not there")
        where = f"{self.path}/data/v={version}"
        rows.write.mode("overwrite").partitionBy(self.date).parquet(where)
        n, low, high = self._rows(where).agg(F.count("*"), F.min(self.date), F.max(self.date)).first()
        first, last = dates or (low, high)
        if mode in REPLACING and n and not (first <= low and high <= last):
            raise ValueError(f"rows of {low} to {high} outside the range {first} to {last}")
        run = self.spark.createDataFrame([(version, mode, first, last, supersedes, n)], _RUN)
        run.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/v={version}")
        if len(after) + 1 >= self.every:
            self.compact()
        return True

    def _rows(self, where: str) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", where).parquet(where)

    def _covered(self, later: list) -> Column:
        out = F.lit(False)
        for r in later:
            if r.first_date is not None:
                out = out | F.col(self.date).between(F.lit(r.first_date), F.lit(r.last_date))
        return out

    def read(self) -> DataFrame:
        """The present rows: the checkpoint and the versions after it, each without the dates that a later version replaces. Dates are
        partitions, so replaced ones are not read."""
        done, after = self._after()
        replacing = [r for r in after if r.mode in REPLACING]
        parts = [self._rows(f"{self.path}/data/c={done}").where(~self._covered(replacing))] if done >= 0 else []
        parts += [self._rows(f"{self.path}/data/v={r.version}").where(~self._covered([x for x in replacing if x.version > r.version])) for r in after if r.mode != "correction"]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def corrections(self) -> DataFrame:
        """Rows of corrections with revision (their version) and supersedes (the version that they correct)."""
        done, after = self._after()
        mark = lambda df, r: df.withColumns({"revision": F.lit(r.version).cast("long"), "supersedes": F.lit(r.supersedes).cast("long")})
        parts = [self.spark.read.schema(f"{self.schema}, revision long, supersedes long").parquet(f"{self.path}/data/k={done}")] if done >= 0 else []
        parts += [mark(self._rows(f"{self.path}/data/v={r.version}"), r) for r in after if r.mode == "correction"]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{self.schema}, revision long, supersedes long")

    def compact(self) -> int:
        """Write the present rows, the corrections and the runs together, then commit them as a checkpoint; versions stay until ``vacuum``."""
        done, after = self._after()
        if not after:
            return done
        now = after[-1].version
        self.read().write.mode("overwrite").partitionBy(self.date).parquet(f"{self.path}/data/c={now}")
        self.corrections().write.mode("overwrite").parquet(f"{self.path}/data/k={now}")
        self.runs().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/c={now}")
        return now

    def vacuum(self) -> int:
        """Delete what the last checkpoint has taken over, and data without a commit; nobody may be reading an older state. Returns the
        number of folders."""
        done, n = self.checkpoint(), 0
        fs, path = self._fs()
        known = set(self._listed("log", "v"))
        for folder in ("data", "log"):
            at = path(f"{self.path}/{folder}")
            for s in fs.listStatus(at) if fs.exists(at) else []:
                kind, _, number = s.getPath().getName().partition("=")
                old = int(number) <= done if kind == "v" else int(number) < done
                if old or kind == "v" and int(number) not in known:
                    fs.delete(s.getPath(), True)
                    n += 1
        return n

    def sink(self, stream: DataFrame, checkpoint: str, describe: Callable[[DataFrame], tuple[str, tuple | None, int | None]]) -> StreamingQuery:
        """Each batch as the version of its number; ``describe`` gives its mode, range and superseded version."""

        def write(batch: DataFrame, number: int) -> None:
            mode, dates, supersedes = describe(batch)
            self.commit(number, batch, mode, dates, supersedes)

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
