"""Many log types in one run: each is trained, compressed or restored on its own, and one that fails does not stop the rest.

Every step of every type leaves a row (type, step, at, seconds, status, error, lines, raw_bytes, encoded_bytes). Rows are appended to
a table, so runs add up; `summary` gives totals of time, errors and sizes a type and for all.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.config import LogConfig
from timberline.plans import pipeline
from timberline.plans.model import Model
from timberline.sources.lines import read_lines

LOG = "type string, step string, at timestamp, seconds double, status string, error string, lines long, raw_bytes long, encoded_bytes long"


def timed(kind: str, step: str, work: Callable[[], dict]) -> tuple:
    """A row of the log; an error is noted and not raised."""
    at, began = datetime.now(timezone.utc).replace(tzinfo=None), time.monotonic()
    try:
        sizes, status, error = work(), "ok", None
    except Exception as e:  # whatever went wrong with this type is its own
        sizes, status, error = {}, "failed", f"{type(e).__name__}: {e}"[:500]
    return (kind, step, at, time.monotonic() - began, status, error, *[sizes.get(k) for k in ("lines", "raw_bytes", "encoded_bytes")])


def train_type(spark: SparkSession, config: LogConfig, source: str, model: str, sample: bool = True, miner: str = "tree") -> dict:
    lines = read_lines(spark, source)
    pipeline.train(lines, config, miner, sample).save(spark, model)
    return measured(lines)


def compress_type(spark: SparkSession, config: LogConfig, source: str, model: str, target: str, archive: bool = False) -> dict:
    lines = read_lines(spark, source)
    pipeline.compress(lines, Model.load(spark, model), config, archive).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return measured(lines) | {"encoded_bytes": spark.read.parquet(target).agg(F.sum(F.octet_length("payload"))).first()[0]}


def restore_type(spark: SparkSession, config: LogConfig, source: str, model: str, target: str) -> dict:
    written = pipeline.write_log(pipeline.restore(spark.read.parquet(source), Model.load(spark, model), config), target)
    n, size = written.agg(F.sum("lines"), F.sum("bytes")).first()
    return {"lines": n, "raw_bytes": size}


def measured(lines: DataFrame) -> dict:
    n, size = lines.agg(F.count("*"), F.sum(F.length("line") + 1)).first()
    return {"lines": n, "raw_bytes": size}


def run(spark: SparkSession, types: Iterable[str], steps: Iterable[str], config_of: Callable[[str], LogConfig], logs: str, models: str, encoded: str | None = None, restored: str | None = None, log: str | None = None, archive: bool = False) -> DataFrame:
    """The log of this run; log: a table that it is appended to. Type T is read from logs/T, and so on for the other folders."""
    rows = []
    for kind in types:
        config = config_of(kind)
        work = {
            "train": lambda kind=kind, config=config: train_type(spark, config, f"{logs}/{kind}", f"{models}/{kind}"),
            "compress": lambda kind=kind, config=config: compress_type(spark, config, f"{logs}/{kind}", f"{models}/{kind}", f"{encoded}/{kind}", archive),
            "restore": lambda kind=kind, config=config: restore_type(spark, config, f"{encoded}/{kind}", f"{models}/{kind}", f"{restored}/{kind}"),
        }
        for step in steps:
            rows.append(timed(kind, step, work[step]))
            if rows[-1][4] != "ok":
                break  # what follows needs this step
    made = spark.createDataFrame(rows, LOG)
    if log:
        made.write.mode("append").parquet(log)
    return made


def summary(log: DataFrame) -> DataFrame:
    """(type, seconds, errors, raw_bytes, encoded_bytes, ratio) of each type, and of all with a null type."""
    sizes = [F.sum(F.when(F.col("step") == "compress", F.col(c))).alias(c) for c in ("raw_bytes", "encoded_bytes")]
    found = log.rollup("type").agg(F.sum("seconds").alias("seconds"), F.count_if(F.col("status") != "ok").alias("errors"), *sizes)
    return found.withColumn("ratio", F.col("raw_bytes") / F.col("encoded_bytes"))
