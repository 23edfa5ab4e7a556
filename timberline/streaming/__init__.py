"""Parsing and encoding a stream of log lines with a trained model.

The model is static and each micro-batch is stateless, so no watermark or state is needed: a batch of lines is a block,
and multi-line records are framed within it. Batches are written with their number as block, which makes a repeated
batch overwrite itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.config import LogConfig
from timberline.plans import pipeline
from timberline.plans.model import Model


def parse_stream(lines: DataFrame, model: Model, config: LogConfig) -> DataFrame:
    """A stream (line) -> (line, status, toks, eid, vars), for single-line records; runs in any output mode."""
    from timberline.operators import framing, header, matching
    from timberline.operators import tokens as tk

    records = lines.select(F.col("line").alias("raw"), F.when(F.length("line") == 0, "empty").otherwise("head").alias("kind"))
    records = records.withColumn("status", framing.status(config)).drop("kind")
    parsed = header.with_head(records, config.head_slots)
    parsed = parsed.withColumn("status", header.head_status(model.slots, config))
    parsed = parsed.withColumn("toks", F.when(F.col("status") == "ok", tk.tokens(F.col("head.content"))))
    return matching.match(parsed, model.table(lines.sparkSession), config)


def encode_stream(lines: DataFrame, model: Model, config: LogConfig, path: str, checkpoint: str) -> StreamingQuery:
    """A stream (line_no, line) -> encoded blocks under path, one a micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        blocks = batch.withColumn("block_id", F.lit(number).cast("long"))
        pipeline.compress(blocks, model, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
