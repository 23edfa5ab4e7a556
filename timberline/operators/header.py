"""Header columns: split, formats learned from a sample, typed parse and its inverse.

A format is a list of pieces: a literal, or a digit run with a fixed width (0: any). A slot whose values share no format
is a string. Parsing a value by its format and printing it again gives the value, or it is kept as a string (so leading
zeros, signs and overflow survive).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.config import LogConfig

VALUE, GAP = r"[^ \t|\n]+", r"[ \t|]*"


@dataclass(frozen=True)
class Slot:
    """pieces: None for a string slot, else literals (str) and digit widths (int)."""

    pieces: tuple[str | int, ...] | None

    @property
    def numbers(self) -> int:
        return sum(isinstance(p, int) for p in self.pieces or ())

    def pattern(self) -> str:
        """A full-match pattern with a group for each number."""
        if self.pieces is None:
            return "^(.*)$"
        return "^" + "".join(re.escape(p).replace("/", "\\/") if isinstance(p, str) else (f"([0-9]{{{p}}})" if p else "(0|[1-9][0-9]{0,17})") for p in self.pieces) + "$"


def split_head(raw: Column, slots: int) -> Column:
    """(values, gaps, content): the first `slots` values, the separators around them, and what follows the last.

    gaps[0] stands before the first value. With fewer values than slots, all are given and content is null.
    """
    if not slots:
        return F.struct(F.expr("cast(array() as array<string>)").alias("values"), F.expr("cast(array() as array<string>)").alias("gaps"), raw.alias("content"))
    head = f"^({GAP}(?:{VALUE}{GAP}){{{slots}}})"
    # the content starts at the line's last head gap; delimiters of content right after the head belong to the gap
    text = F.regexp_extract(raw, head, 1)
    whole = F.length(text) > 0
    values = F.regexp_extract_all(F.when(whole, text).otherwise(raw), F.lit(VALUE), F.lit(0))
    gaps = F.split(F.when(whole, text).otherwise(raw), VALUE, -1)
    return F.struct(F.slice(values, 1, slots).alias("values"), gaps.alias("gaps"), F.when(whole, F.substring(raw, F.length(text) + 1, F.length(raw))).alias("content"))


def with_head(records: DataFrame, slots: int) -> DataFrame:
    return records.withColumn("head", split_head(F.col("raw"), slots))


def runs(value: Column) -> Column:
    """Digit and other runs of a value."""
    return F.regexp_extract_all(value, F.lit("[0-9]+|[^0-9]+"), F.lit(0))


def infer_slots(parsed: DataFrame, config: LogConfig) -> list[Slot]:
    """Formats of the slots from the first `head_sample` records (column head, ordered by block_id, rec_id).

    One pass per level: the modal number of runs, then each run's modal part or width; a part or number of runs that
    falls short of head_share makes the slot a string, a width that does makes it free. Ties go to the smaller value.
    """
    if not config.head_slots:
        return []
    sample = parsed.where(F.col("head.content").isNotNull()).orderBy("block_id", "rec_id").limit(config.head_sample)
    flat = sample.select(F.posexplode("head.values").alias("slot", "v")).select("slot", runs(F.col("v")).alias("runs")).withColumn("n_runs", F.size("runs")).cache()
    total = W.partitionBy("slot")
    counts = flat.groupBy("slot", "n_runs").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(total))
    first = counts.withColumn("nth", F.row_number().over(total.orderBy(F.desc("n"), "n_runs"))).where("nth = 1").select("slot", F.col("n_runs").alias("modal"), "share")
    parts = flat.join(F.broadcast(first.where(F.col("share") >= config.head_share)), "slot").select("slot", "modal", F.posexplode("runs").alias("at", "part")).where("at < modal")
    digit = F.col("part").rlike("^[0-9]")
    keyed = parts.select("slot", "at", digit.alias("digit"), F.when(digit, F.length("part").cast("string")).otherwise(F.col("part")).alias("key"))
    by = W.partitionBy("slot", "at")
    modes = keyed.groupBy("slot", "at", "digit", "key").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(by)).withColumn("digits", F.sum(F.when(F.col("digit"), F.col("n")).otherwise(0)).over(by) / F.sum("n").over(by))
    found = modes.withColumn("nth", F.row_number().over(by.orderBy(F.desc("n"), F.length("key"), "key"))).where("nth = 1").collect()  # a row for each run of a slot
    flat.unpersist()
    slots: list[Slot] = []
    for i in range(config.head_slots):
        own = sorted((r for r in found if r["slot"] == i), key=lambda r: r["at"])
        pieces: list[str | int] | None = []
        for r in own:
            if r["digit"] and r["digits"] >= config.head_share:
                pieces.append(int(r["key"]) if r["share"] >= config.head_share and int(r["key"]) <= 18 else 0)
            elif not r["digit"] and r["share"] >= config.head_share and len(own) > 1:
                pieces.append(r["key"])
            else:
                pieces = None
                break
        slots.append(Slot(tuple(pieces) if pieces else None))
    return slots


def parse_slot(value: Column, slot: Slot) -> Column:
    """The numbers of a value as array<bigint>; null if it does not fit the format."""
    if slot.pieces is None:
        return F.lit(None).cast("array<bigint>")
    numbers = F.array(*[F.regexp_extract(value, slot.pattern(), i + 1).cast("bigint") for i in range(slot.numbers)])
    return F.when(value.rlike(slot.pattern()), numbers)


def print_slot(numbers: Column, slot: Slot) -> Column:
    """The inverse of parse_slot."""
    out, at = [], 0
    for p in slot.pieces or ():
        if isinstance(p, str):
            out.append(F.lit(p))
            continue
        text = F.element_at(numbers, at + 1).cast("string")
        out.append(F.when(F.length(text) < p, F.lpad(text, p, "0")).otherwise(text) if p else text)
        at += 1
    return F.concat(*out)


def head_status(slots: list[Slot], config: LogConfig) -> Column:
    """Of parsed records (head, status): the reasons that a header adds. String slots fit anything."""
    fits = F.lit(True)
    for i, slot in enumerate(slots):
        if slot.pieces is not None:
            fits = fits & F.get(F.col("head.values"), F.lit(i)).rlike(slot.pattern())
    n = F.size("head.values")
    return (
        F.when(F.col("status") != "ok", F.col("status"))
        .when((n < config.head_slots) | F.col("head.content").isNull(), "load_failed:wrong_format")
        .when(~fits, "load_failed:wrong_format")
        .when(F.length("head.content") == 0, "load_failed:no_content")
        .otherwise("ok")
    )
