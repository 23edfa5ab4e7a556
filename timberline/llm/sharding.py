"""Sharding by minimax contiguous partition.

Rows with equal text form one atomic group. Groups are ordered by a hash of the text. The smallest capacity for which the
ordered sizes fit into the shards is found by binary search, with a greedy check of each capacity, and the groups are cut there.

The driver never holds a group a row. It starts from the sums of `BUCKETS` ranges of hashes. A capacity that fits ranges
fits groups, and none below an even share or the largest group does; only ranges in which a cut can lie for a capacity
between these two are looked into, by finer ranges and again, until every range that matters is a single group. So the capacity is
the least one over the groups themselves, from at most `FINE` sums at a time. A row's shard is then a plain expression of its text.

Nulls: a null text counts as empty. Repeated rows are kept and numbered apart. Ties in doc_id within a text are numbered in
the order of reading. An empty table gives no rows. A text larger than a fair share sets the capacity. Texts are hashed and
measured whole. Other columns of the input are neither read nor returned by `shard_documents`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.llm.common import materialize

#: Bits of a group's place in the order, of a first range; ranges that the driver gets at once.
BITS, DEPTH, FINE = 63, 16, 1 << 18
BUCKETS = 1 << DEPTH
ROW_BYTES = 16


def pieces(sizes: np.ndarray, capacity: int) -> list[int]:
    """Greedy check: the ends of the runs when each run takes as many groups as capacity allows."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends, at = [], 0
    while at < len(sizes):
        at = max(at + 1, int(np.searchsorted(total, total[at] + capacity, side="right")) - 1)
        ends.append(at)
    return ends


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which the ordered sizes fit into so many contiguous shards."""
    if not len(sizes):
        return 0
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        if len(pieces(sizes, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """Starts of shards 1..shards-1 as positions in sizes; no shard is over the smallest capacity.

    Among the cuts that keep the capacity, each is put nearest to an even share of what is left, so that the slack is
    spread over the shards and not left to the last.
    """
    capacity, n = smallest_capacity(sizes, shards), len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    latest = [n]  # latest[s]: the first position from which s shards can still take the rest
    for _ in range(shards):
        latest.append(int(np.searchsorted(total, total[latest[-1]] - capacity, side="left")))
    out, at = [], 0
    for left in range(shards, 1, -1):
        most = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        least = max(at, latest[left - 1])
        aim = total[at] + (total[n] - total[at]) / left
        near = int(np.searchsorted(total, aim, side="left"))
        if near > 0 and near <= n and aim - total[near - 1] < total[min(near, n)] - aim:
            near -= 1
        at = min(max(near, least), most)
        out.append(at)
    return out


def place(text: Column) -> Column:
    """A group's place in the order: a hash of the text, not negative."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - BITS)


def size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


class Ranges:
    """Ordered ranges of places: (depth, number, bytes, rows, whether all of it is one group)."""

    def __init__(self, rows: list[tuple[int, int, int, int, bool]]):
        self.rows = sorted(rows, key=lambda r: r[1] << (BITS - r[0]))
        self.sizes = np.array([r[2] for r in self.rows], dtype=np.int64)
        self.single = np.array([r[4] for r in self.rows], dtype=bool)

    def start(self, i: int) -> int:
        depth, number, *_ = self.rows[i]
        return number << (BITS - depth)

    def unclear(self, shards: int) -> list[int]:
        """The ranges that a cut of the least capacity may part."""
        if not len(self.rows):
            return []
        total = np.concatenate([[0], np.cumsum(self.sizes)])
        least = max(-(-int(total[-1]) // shards), int(self.sizes[self.single].max(initial=0)))
        if len(wide := np.flatnonzero(~self.single & (self.sizes > least))):
            return wide.tolist()
        most = smallest_capacity(self.sizes, shards)
        if most == least:
            return []
        found = set()
        for s, end in enumerate(pieces(self.sizes, least)[: shards - 1], start=1):
            # ranges hold groups together, so a cut of the groups is never before one of the ranges with less room
            last = int(np.searchsorted(total, min(s * most, int(total[-1])), side="left"))
            found.update(range(end, min(last, len(self.rows))))
        return [i for i in sorted(found) if not self.single[i]]


def sums(sized: DataFrame, depth: int) -> list[tuple[int, int, int, int, bool]]:
    """sized (place, size) -> its ranges of this depth."""
    each = sized.groupBy(F.shiftrightunsigned("place", BITS - depth).alias("number")).agg(F.sum("size"), F.count("*"), F.min("place") == F.max("place"))
    return [(depth, *r) for r in each.collect()]  # at most BUCKETS, or FINE


def plan(sized: DataFrame, shards: int) -> tuple[list[int], dict[int, int]]:
    """sized (place, size) -> (first place of each shard but the first, rows of each bucket)."""
    spark = sized.sparkSession
    first = sums(sized, DEPTH)
    ranges = Ranges(first)
    while unclear := ranges.unclear(shards):
        depths = [r[0] for r in ranges.rows]
        depth = min(depths[i] for i in unclear)
        chosen = [i for i in unclear if depths[i] == depth]
        # each step goes a bit deeper at least, and for few ranges many
        below = min(BITS, depth + max(1, (FINE // len(chosen)).bit_length() - 1))
        names = spark.createDataFrame([(ranges.rows[i][1],) for i in chosen], "number long")
        part = sized.join(F.broadcast(names), F.shiftrightunsigned("place", BITS - depth) == F.col("number"), "left_semi")
        gone = set(chosen)
        ranges = Ranges([r for i, r in enumerate(ranges.rows) if i not in gone] + sums(part, below))
    starts = [ranges.start(i) if i < len(ranges.rows) else 1 << BITS for i in cuts(ranges.sizes, shards)]
    return starts, {number: rows for _, number, _, rows, _ in first}


def shard_of(at: Column, starts: list[int]) -> Column:
    return F.size(F.filter(F.lit([s for s in starts if s < 1 << BITS]), lambda s: s <= at)) if any(s < 1 << BITS for s in starts) else F.lit(0)


def assign_shards(docs: DataFrame, shards: int = 40, text: str = "text", into: str = "shard") -> DataFrame:
    """docs with one more column, the shard. The texts are not shuffled. A column named `into` is replaced."""
    sized = materialize(docs.select(place(F.col(text)).alias("place"), size(F.col(text)).alias("size")), "shard-sizes")
    starts, _ = plan(sized, shards)
    return docs.withColumn(into, shard_of(place(F.col(text)), starts))


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot (0.. within the shard), grown_shard.

    Slots are numbered within cells and shifted by the rows of the cells before, so no task sorts a whole shard. A cell
    is a bucket, or a part of it when it holds over 1/1024 of all rows (a hot text).
    """
    t = F.col(text)
    slim = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), size(t).alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), place(t).alias("place"), F.monotonically_increasing_id().alias("row")),
        "shard-rows",
    )
    starts, counts = plan(slim, shards)
    most = max(512, sum(counts.values()) // 1024)
    hot = {b: -(-n // most) for b, n in counts.items() if n > most}  # at most 1,024 buckets
    slim = slim.withColumn("bucket", F.shiftrightunsigned("place", BITS - DEPTH))
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("bucket")), F.lit(1)) if hot else F.lit(1)
    slim = slim.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).withColumn("shard", shard_of(F.col("place"), starts).cast("int"))

    cell = ["shard", "bucket", "part"]
    cells = slim.groupBy(*cell).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket", "part").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select(*cell, F.coalesce(before, F.lit(0)).alias("before"))
    # cells: a row a bucket, 2,048 parts of hot ones and a row a cut at most; at about 100 bytes each in the broadcast table, 7 MB
    return (
        slim.withColumn("nth", F.row_number().over(W.partitionBy(*cell).orderBy("doc_id", "row")))
        .join(F.broadcast(cells), cell)
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
