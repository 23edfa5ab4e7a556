"""Benchmark decontamination with a broadcast hash table of normalised n-grams. DataFrame functions only.

Every run of `n` consecutive words of a benchmark item is a window; an item of fewer words is one window. The windows'
hashes are broadcast, each document hashes its own runs of the same lengths inside one array expression, and the runs
are exploded into a hash join in the same stage: only runs whose hash is known leave it, after their words were compared
with the window's. The empty window is in the table too and occurs once in every document, so documents without a hit
come through the same join and no second scan or outer join is needed. One small shuffle then gathers a row's hits.

The table is broadcast only up to `BROADCAST_BYTES`, as summed over its windows and items; more is cut into slices by hash,
one pass over the documents for each. A single window is never cut.

Time and memory are linear in a text's words: the runs of a text are (place, hash) pairs, and its words are read where a
hash is known but not copied into each run.

Nulls: a null text has no words. An item without text has no windows; one without an id hits words and is not listed.
Repeated documents each get a row; repeated items count once. Empty tables: no rows, or nothing is hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import ascii_lower, broadcast_if_small, materialize, unused

#: Bytes of one broadcast: the windows' words and items, and WINDOW_BYTES for each window.
BROADCAST_BYTES, WINDOW_BYTES = 64 << 20, 128
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, items, h, length): each distinct window and the items it occurs in."""
    items = benchmark.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    items = items.withColumn("k", F.least(F.lit(n), F.size("w")))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("k")))).alias("window"))
    found = each.groupBy("window").agg(F.collect_set("item").alias("items"))
    return found.select("window", "items", F.xxhash64("window").alias("h"), F.size("window").alias("length"))


def runs(length: int) -> Column:
    """(pos, h) of every run of so many words in the column w."""
    starts = F.when(F.size("w") >= length, F.sequence(F.lit(1), F.size("w") - length + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("w", i, length)).alias("h")))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_words, hits (pos, length; sorted), items (distinct)."""
    windows = materialize(windows_of(benchmark, n, item_id, item_text), "windows")
    weight = F.octet_length(F.array_join("window", " ")) + 16 * F.size("items") + 8 * F.size("window") + WINDOW_BYTES
    sizes = windows.groupBy("length").agg(F.sum(weight)).collect()  # at most n rows
    lengths, slices = sorted(r[0] for r in sizes), max(1, -(-sum(r[1] for r in sizes) // BROADCAST_BYTES))
    empty = docs.sparkSession.range(1).select(F.expr("cast(array() as array<string>)").alias("window"), F.lit(None).cast(windows.schema["items"].dataType).alias("items"))
    empty = empty.select("window", "items", F.xxhash64("window").alias("h"), F.lit(0).alias("length"))

    own = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("w"))
    own = own.select("*", F.size("w").cast("long").alias("n_words"))
    found = []
    for i in range(slices):
        part = windows if slices == 1 else windows.where(F.pmod("h", F.lit(slices)) == i)
        if i == 0:
            part = part.unionByName(empty)
        first = F.array(F.struct(F.lit(1).alias("pos"), F.xxhash64(F.expr("cast(array() as array<string>)")).alias("h"))) if i == 0 else None
        every = [x for x in (first, *map(runs, lengths)) if x is not None]
        # the array is made first: a generator over a plain column is compiled with what follows, and `w` is not copied for each run
        at = own.select("doc_id", "row", "text_hash", "n_words", "w", F.concat(*every).alias("runs")).select("doc_id", "row", "text_hash", "n_words", "w", F.inline("runs"))
        hit = at.join(F.broadcast(part), "h").where(F.slice("w", F.col("pos"), F.col("length")) == F.col("window"))
        found.append(hit.select("doc_id", "row", "text_hash", "n_words", F.when(F.col("length") > 0, F.struct("pos", "length")).alias("hit"), "items"))
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("row", "doc_id", "text_hash", "n_words")
        .agg(F.array_sort(F.collect_set("hit")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )


def covered() -> Column:
    """Words inside any of the sorted hits."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["pos"]))).alias("n"))

    return F.aggregate("hits", start, add, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs, benchmark, n, doc_id, text, item_id, item_text)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, spans: bool = False, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with the same columns, without the documents that hold a window; with spans, without the words hit instead.

    A span runs from its first word to the start of the word after it. The flagged documents are written first, so the
    join that drops them is a broadcast where they are few and a shuffle where they are many.
    """
    of, like, hits, pieces = (unused(docs, x) for x in ("of", "like", "hits", "pieces"))
    flagged = find_hits(docs, benchmark, n, doc_id, text, item_id, item_text).where("size(hits) > 0")
    flagged = materialize(flagged.groupBy("doc_id", "text_hash").agg(F.first("hits").alias(hits)).select(F.col("doc_id").alias(of), F.col("text_hash").alias(like), hits), "flagged")
    same = F.col(of).eqNullSafe(docs[doc_id]) & (F.col(like) == F.xxhash64(docs[text]))
    if not spans:
        return docs.join(broadcast_if_small(flagged.select(of, like)), same, "left_anti")
    # pieces: a word and what stands after it; before the first word stands the head
    word, gap = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    cut = docs.join(flagged, same, "left").withColumn(pieces, F.when(F.col(hits).isNotNull(), F.regexp_extract_all(F.col(text), F.lit(f"({word}{gap})"), F.lit(1))))
    gone = F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["length"] - 1)))
    left = F.array_except(F.when(F.size(pieces) > 0, F.sequence(F.lit(1), F.size(pieces))), gone)  # by a hash table: linear
    whole = F.concat(F.regexp_extract(F.col(text), f"^{gap}", 0), F.array_join(F.transform(left, lambda i: F.get(F.col(pieces), i - 1)), ""))
    return cut.withColumn(text, F.when(F.col(hits).isNotNull(), whole).otherwise(F.col(text))).select(*docs.columns)
