"""Records from lines, and the limits that route a record to the failure stream.

Multi-line framing: a line whose first token matches the boundary in full starts a record; other lines continue it. An
empty line is a failed record of its own and closes the one before; a line that nothing is open for is one as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.config import LogConfig


def first_token(line: Column) -> Column:
    return F.regexp_extract(line, r"^[ \t|]*([^ \t|]*)", 1)


def mark_records(lines: DataFrame, keys: list[str], boundary: str | None, order: str = "line_no", search: bool = False) -> DataFrame:
    """lines with kind (head, empty, part, orphan) and rec_id, counted from 1 within keys. One sort by (keys, order).

    search: the boundary may be found anywhere in the first token.
    """
    empty = F.length("line") == 0
    w = W.partitionBy(*keys).orderBy(order)
    if boundary is None:
        return lines.withColumn("kind", F.when(empty, "empty").otherwise("head")).withColumn("rec_id", F.row_number().over(w).cast("long"))
    head = first_token(F.col("line")).rlike(boundary if search else f"^(?:{boundary})$")
    kind = F.when(empty, "empty").when(head, "head")
    last = F.last(kind, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = lines.withColumn("kind", F.coalesce(kind, F.when(last == "head", "part").otherwise("orphan")))
    starts = F.sum(F.when(F.col("kind") == "part", 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marked.withColumn("rec_id", starts.cast("long"))


def status(config: LogConfig) -> Column:
    """Of a record (kind, raw): ok or load_failed:<reason>; the first that applies."""
    return (
        F.when(F.col("kind") == "empty", "load_failed:empty")
        .when(F.col("kind") == "orphan", "load_failed:no_head")
        .when(F.instr("raw", "\x00") > 0, "load_failed:bad_char")
        .when(F.length("raw") > config.max_chars, "load_failed:too_long")
        .otherwise("ok")
    )


def frame(lines: DataFrame, keys: list[str], config: LogConfig, order: str = "line_no") -> DataFrame:
    """(keys, rec_id, raw, n_lines, status)."""
    marked = mark_records(lines, keys, config.boundary, order, config.search)
    if config.boundary is None:
        records = marked.select(*keys, "rec_id", "kind", F.col("line").alias("raw"), F.lit(1).cast("long").alias("n_lines"))
    else:
        parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line").alias("l"))))
        records = marked.groupBy(*keys, "rec_id").agg(F.min("kind").alias("kind0"), F.max("kind").alias("kind1"), parts.alias("p"), F.count("*").alias("n_lines"))
        # a record's kinds are its first line's and `part`, which sorts last
        kind = F.when(F.col("kind0") == "part", F.col("kind1")).otherwise(F.col("kind0"))
        records = records.select(*keys, "rec_id", kind.alias("kind"), F.array_join(F.transform("p", lambda x: x["l"]), "\n").alias("raw"), "n_lines")
    return records.withColumn("status", status(config)).drop("kind")
