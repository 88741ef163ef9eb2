"""Staged runs: one Spark job a stage, each reading the tables that earlier stages wrote; a gate stops what follows it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stages of a delivery, in order.
STAGES = ["profile", "map", "dq", "reconcile", "certify", "analyze", "monitor", "report"]


class Stage(NamedTuple):
    """run: from the tables of the stages before, by name, to this stage's. gate: SQL that must hold for every row of it."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    gate: str | None = None


def run_stages(spark: SparkSession, at: str, stages: list[Stage]) -> DataFrame:
    """(stage, status, rows) of a run whose tables lie under the folder ``at``: done, blocked (its gate does not hold) or skipped
    (after a blocked one). A stage whose table is complete is read, not run again, so a run that broke off goes on there."""
    done: dict[str, DataFrame] = {}
    log, blocked = [], False
    for stage in stages:
        if blocked:
            log.append((stage.name, "skipped", None))
            continue
        path = f"{at}/{stage.name}"
        whole = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(whole):
            stage.run(done).write.mode("overwrite").parquet(path)
        done[stage.name] = spark.read.parquet(path)
        rows, holds = done[stage.name].agg(F.count("*"), F.coalesce(F.bool_and(F.expr(stage.gate or "true")), F.lit(stage.gate is None))).first()
        blocked = not holds
        log.append((stage.name, "blocked" if blocked else "done", rows))
    return spark.createDataFrame(log, "stage string, status string, rows long")
