"""Byte-exact line sources and block selection.

Text is read as Latin-1 so that each byte is one character and none is lost; carriage returns and NULs stay. A file's
last line counts only if it is not empty, and whether the file ended in a line feed is kept beside it. Files are read in ranges, so one file
may be larger than a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.config import LogConfig


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, part, nth, size, raw): lines as bytes; start: where the range of the file that a task reads begins."""
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.spark_partition_id().alias("part"), nth.alias("nth"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("raw"),
    )


def read_lines(spark: SparkSession, path: str, charset: str = "ISO-8859-1") -> DataFrame:
    """(file, line_no, line, final_newline) of the files under path, each file read in ranges by many tasks.

    line_no is dense from 0 in each file. A first pass counts the lines and bytes of each range (a row a range, broadcast); the
    second adds a line's number in its range to the lines before the range. Should the ranges differ between the passes, because the
    session's parallelism changed meanwhile, the read fails and says so. The bytes of a file tell whether it ended in a line
    feed; of compressed files, which hide their bytes, it is taken to.
    """
    rows = _ranges(spark, path)
    counted = rows.groupBy("file", "start", "part", "size").agg(F.count("*").alias("n"), F.min("nth").alias("first"), F.sum(F.octet_length("raw") + 1).alias("bytes"))
    own = W.partitionBy("file")
    before = F.sum("n").over(own.orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    ended = ~((F.sum("bytes").over(own) == F.col("size") + 1))
    places = counted.select(F.col("file").alias("of"), F.col("start").alias("from"), F.col("part").alias("by"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), ended.alias("final_newline"))
    found = rows.join(F.broadcast(places), (F.col("file") == F.col("of")) & (F.col("start") == F.col("from")) & (F.col("part") == F.col("by")), "left")
    sure = F.when(F.col("shift").isNull(), F.raise_error(F.lit("the ranges of the files changed between two passes; read again"))).otherwise(F.col("shift"))
    return found.select("file", (F.col("nth") + sure).cast("long").alias("line_no"), (F.col("raw").cast("string") if charset == "UTF-8" else F.decode("raw", charset)).alias("line"), "final_newline")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for UTF-8 text, so that characters and not bytes are the units of lengths and patterns."""
    return read_lines(spark, path, "UTF-8")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A folder whose files `<n>.col` are blocks already: lines with block_id from the file's name."""
    lines = read_lines(spark, path)
    return lines.withColumn("block_id", F.regexp_extract("file", r"(\d+)\.[^./]*$", 1).cast("long"))


def with_blocks(lines: DataFrame, block_lines: int, order: str = "line_no") -> DataFrame:
    return lines.withColumn("block_id", F.floor(F.col(order) / block_lines).cast("long"))


def block_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Blocks first to last; on tables partitioned by block_id the others are not read."""
    return lines.where(F.col("block_id").between(first, last))


def block_hash(block: Column, file: Column | None = None) -> Column:
    """A portable scramble of block numbers that any SQL engine can repeat; files shift it by the CRC-32 of their names."""
    of = F.lit(0) if file is None else F.crc32(file.cast("binary"))
    return F.pmod(block * F.lit(2654435761) + of, F.lit(4294967296))


def sample_blocks(lines: DataFrame, config: LogConfig, order: str = "line_no") -> DataFrame:
    """Lines of the sampled blocks of config.sample_block lines: those with the smallest scrambled numbers of all files.

    The number of blocks is sample_rate of all, within the limits; never more than there are. Lines without a file are one file.
    """
    file = F.coalesce(F.col("file"), F.lit("")) if "file" in lines.columns else F.lit("")
    keyed = lines.withColumn("small_block", F.floor(F.col(order) / config.sample_block).cast("long"))
    blocks = keyed.select(file.alias("of"), F.col("small_block").alias("at")).distinct()
    n = blocks.count()
    m = min(n, min(max(int(n * config.sample_rate), config.sample_least), config.sample_most))
    chosen = blocks.orderBy(block_hash(F.col("at"), F.col("of")), "of", "at").limit(m)  # at most sample_most rows
    return keyed.join(F.broadcast(chosen), (F.col("small_block") == F.col("at")) & (file == F.col("of")), "left_semi")
