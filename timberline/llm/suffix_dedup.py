"""Suffix-array dedup: removes every byte covered by a string of `LENGTH` bytes that also starts in an earlier document.

A suffix array over all bytes would ship each byte about fifty times. This one is sparse: suffixes start only at anchors,
positions chosen by content such that every string of LENGTH bytes holds at least one and equal strings choose the same
(the place of the smallest hash among the string's k-mers). About one byte in fourteen is an anchor.

1. Anchors whose k-mer occurs in one text alone cannot be part of a repeat. One shuffle of (k-mer hash, text hash, place)
   drops them; the window that finds them sorts and spills, and what a batch knows to be shared takes no part in it but
   for two rows, so a frequent k-mer is neither a hot key nor held in memory. Of a text with many copies only the first is looked at.
2. For the anchors left, the suffix's leading bytes and the few bytes before it are shipped to buckets cut by sampled
   splitters over the leading three 8-byte tokens. Equal contexts of one batch are decided on the spot and only the earliest is
   shipped, so the inside of a hot passage arrives once a batch; what is decided goes to any bucket. At the borders of a hot
   passage contexts differ. A k-mer that the sample shows to hold more than a bucket is split: strings that start in a
   range of places before the anchor share the bytes that all of them have, so for each range the contexts are dealt by these
   bytes. That sends such a context once for each of `RANGES`, and only some of them with all others of its k-mer.
3. A bucket sorts its suffixes by multikey quicksort on 8-byte tokens, and what stands before them likewise, backwards.
   Neighbours' common lengths to both sides give, for each offset, the classes of equal strings; each class knows its
   smallest document. Splitters never part equal leading tokens, so no string crosses a boundary.
4. Runs are merged per document and cut out.

Exact copies of a text are found by digest first: all but the earliest lose everything (if LENGTH bytes long) and are no
part of step 2. Step 1 tells texts apart by 64-bit hashes; a pair of texts would have to collide to hide its repeats.

Nulls: a null text counts as empty. A row without an id loses nothing and takes nothing from others. Repeated rows (same
id) take nothing from one another. An empty table gives no rows. Ties: of documents that share a string the smallest id keeps it,
and copies of a text with that id keep it too; a string twice in one document is no repeat. Texts are read whole, as UTF-8
bytes, in pieces of `SEGMENT` bytes, in time linear in their length but for the sort of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.llm.common import bound_batches, broadcast_if_small, buffers, lookup_hot, materialize

LENGTH, K = 50, 24
#: Bytes before an anchor that a string with this anchor can start at, and bytes of a context.
BACK = LENGTH - K
WIDTH = BACK + LENGTH
#: Bytes hashed at once (with 21 bits for a place), contexts of a bucket, most buckets, most suffixes sampled for splitters.
SEGMENT, BUCKET, MOST_BUCKETS, SAMPLE = 1 << 20, 1 << 15, 1 << 16, 1 << 17
#: Copies of a text from which on all but the first are left out before its anchors are made.
MANY = 64
#: Ranges of places before an anchor, first and last, by which a hot k-mer's contexts are dealt; together all places.
RANGES = ((0, 0), (1, 1), (2, 2), (3, 3), (4, 6), (7, 13), (14, BACK))

BASE = 0x9E3779B97F4A7C15
LOW = np.uint64((1 << 21) - 1)
_tables: dict[str, np.ndarray] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    if not _tables:
        up = np.full(SEGMENT + 1, BASE, dtype=np.uint64)
        down = np.full(SEGMENT + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _tables["up"], _tables["down"] = np.cumprod(up), np.cumprod(down)
    return _tables["up"], _tables["down"]


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    up, down = powers()
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[K:] - sums[:-K]) * down[: n - K + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    now, span = key, 1
    while span * 2 <= width:
        now = np.minimum(now[:-span], now[span:])
        span *= 2
    return np.minimum(now[: len(now) - (width - span)], now[width - span :]) if span < width else now


def segment_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes); ends: for each byte, where its document ends. At most SEGMENT bytes."""
    if len(data) < LENGTH:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    h = kmer_hashes(data)
    least = least_in_windows((h & ~LOW) | np.arange(len(h), dtype=np.uint64), LENGTH - K + 1)
    inside = ends[: len(least)] - np.arange(len(least)) >= LENGTH
    at = (least[inside] & LOW).astype(np.int64)
    at = at[np.diff(at, prepend=-1) != 0]  # places never go back
    return at, h[at]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's number, place in it, hash) for documents lying side by side in data at offsets."""
    found, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SEGMENT, side="right")) - 1)
        low, high = int(offsets[first]), int(offsets[last])
        for a in range(low, max(high - LENGTH + 1, low + 1), SEGMENT - LENGTH + 1):  # more than one piece for a very long document
            b = min(a + SEGMENT, high)
            ends = np.repeat(np.minimum(offsets[first + 1 : last + 1], b) - a, np.diff(np.clip(offsets[first : last + 1], a, b)))
            at, h = segment_anchors(data[a:b], ends)
            found.append((at + a, h))
        first = last
    if not found:
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.uint64),)
    at, keep = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
    h = np.concatenate([x for _, x in found])[keep]
    doc = np.searchsorted(offsets, at, side="right") - 1
    return doc, at - offsets[doc], h


def known_in_batch(h: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose h occurs with two th or more, those of them that need not be shipped to h: all but two of different th)."""
    order = np.lexsort((th, h))
    hs, ts = h[order], th[order]
    new = np.append(True, hs[1:] != hs[:-1])
    other = np.append(False, (hs[1:] == hs[:-1]) & (ts[1:] != ts[:-1]))  # the first row of another text of the same h
    run = np.cumsum(new) - 1
    several = np.bincount(run, weights=other, minlength=run[-1] + 1) > 0
    seen = np.cumsum(other)
    second = other & (seen - (seen - other)[np.flatnonzero(new)][run] == 1)
    known, spare = np.empty(len(h), dtype=bool), np.empty(len(h), dtype=bool)
    known[order] = several[run]
    spare[order] = several[run] & ~new & ~second
    return known, spare


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, text) -> (key, th, pos, known).

    The key is the k-mer's hash. Where the batch itself holds it in two texts, its rows are known to be shared: two of
    them go to the hash, to tell other batches, and the rest get keys of their own, so a frequent k-mer is no hot key.
    """
    for batch in batches:
        _, once = np.unique(batch.column(0).to_numpy(), return_index=True)
        if len(once) < batch.num_rows:
            batch = batch.take(pa.array(np.sort(once)))
        data, offsets = buffers(batch.column(1))
        doc, pos, h = anchors(data[: offsets[-1]], offsets)
        th = batch.column(0).to_numpy()[doc]
        known = np.zeros(len(h), dtype=bool)
        if len(h):
            known, spare = known_in_batch(h, th)
            own = (th.view(np.uint64) ^ (pos.astype(np.uint64) * np.uint64(BASE))) * np.uint64(0xD6E8FEB86659FD93)
            h = np.where(spare, own ^ (own >> np.uint64(31)), h)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(th), pa.array(pos.astype(np.int32)), pa.array(known)], names=["key", "th", "pos", "known"])


def tokens(contexts: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 8-byte tokens, zero-filled at the end."""
    n, width = contexts.shape
    out = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    out[:, :width] = contexts
    return out.view(">u8").astype(np.uint64)


def leading(kmers: np.ndarray) -> np.ndarray:
    """Rows of K bytes as strings to be compared whole."""
    return np.ascontiguousarray(kmers).view(f"S{K}").ravel()


def multikey_order(contexts: np.ndarray) -> np.ndarray:
    """The order of the rows: sorted by the first token, then runs of equal ones by the next, and so on."""
    parts = tokens(contexts)
    order = np.argsort(parts[:, 0], kind="stable")
    same = np.zeros(len(order), dtype=bool)  # equal to the row before so far
    same[1:] = parts[order[1:], 0] == parts[order[:-1], 0]
    for j in range(1, parts.shape[1]):
        run = np.cumsum(~same)
        open_ = same.copy()
        open_[:-1] |= same[1:]  # in a run of two or more
        at = np.flatnonzero(open_)
        if not len(at):
            break
        rows = order[at]
        order[at] = rows[np.lexsort((parts[rows, j], run[at]))]
        same[1:] &= parts[order[1:], j] == parts[order[:-1], j]
    return order


def common_lengths(contexts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each sorted row with the one before; -1 for the first."""
    out = np.full(len(order), -1, dtype=np.int32)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        differ = contexts[order[a:b]] != contexts[order[a - 1 : b - 1]]
        out[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), contexts.shape[1])
    return out


def repeated(contexts: np.ndarray, left: np.ndarray, right: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest, smallest offset) before each anchor from which a string starts that an earlier document has; -1 for none.

    contexts: rows of WIDTH bytes with the anchor at BACK, of which left before and right from it on are real.
    """
    n = len(docs)
    after, before = contexts[:, BACK:], contexts[:, BACK - 1 :: -1] if BACK else contexts[:, :0]
    far, near = np.full(n, -1), np.full(n, -1)
    forward = multikey_order(after)
    forward_common = common_lengths(after, forward)
    backward = multikey_order(before)
    backward_common = common_lengths(before, backward)
    follow, lead = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(BACK + 1):
        fits = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if len(fits) < 2:
            continue
        follow[forward] = np.cumsum(forward_common < LENGTH - o)
        lead[backward] = np.cumsum(backward_common < o)
        key = (follow[fits] << np.int64(32)) | (lead[fits] if o else 0)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        least = np.repeat(np.minimum.reduceat(docs[fits[order]], starts), np.diff(np.append(starts, len(order))))
        hit = fits[order[docs[fits[order]] > least]]
        far[hit] = o
        near[hit[near[hit] < 0]] = o
    return far, near


def merge(intervals: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def context_rows(splitters: np.ndarray, hot: np.ndarray):
    """(doc_id, mark, positions, text) -> contexts (bucket, doc_id, mark, pos, left, right, ctx); ctx null: decided, [pos - left, pos + right) goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column(3))
            sizes = np.diff(offsets)
            lists = batch.column(2)
            counts = lists.value_lengths().to_numpy()
            pos = lists.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), counts)
            fine = pos + K <= sizes[doc]
            pos, doc = pos[fine], doc[fine]
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids[doc], kind="stable")  # the earliest document first
            pos, doc = pos[order], doc[order]
            for a in range(0, len(pos), 1 << 16):
                yield from contexts_of(data, offsets, sizes, pos[a : a + (1 << 16)], doc[a : a + (1 << 16)], ids, batch.column(1), splitters, hot)

    return run


def contexts_of(data, offsets, sizes, pos, doc, ids, marks, splitters, hot) -> Iterator[pa.RecordBatch]:
    """The contexts of anchors, those of hot k-mers once for each range."""
    first = leading(data[(offsets[doc] + pos)[:, None] + np.arange(K)[None, :]])
    often = hot[np.minimum(np.searchsorted(hot, first), len(hot) - 1)] == first if len(hot) else np.zeros(len(pos), dtype=bool)
    if not often.all():
        plain = ~often
        yield contexts_in(data, offsets, sizes, pos[plain], doc[plain], ids, marks, len(splitters) + 1, np.searchsorted(splitters, first[plain], side="right"), 0, BACK)
    if often.any():
        for low, high in RANGES:
            yield contexts_in(data, offsets, sizes, pos[often], doc[often], ids, marks, len(splitters) + 1, None, low, high)


def contexts_in(data, offsets, sizes, pos, doc, ids, marks, buckets, bucket, low, high) -> pa.RecordBatch:
    """Contexts for strings that start `low` to `high` bytes before the anchor; left and right are cut down to what these can reach.

    bucket: of each, or None to deal them by the bytes that strings of the range have in common.
    """
    left, right = np.minimum(pos, high), np.minimum(sizes[doc] - pos, LENGTH - low)
    at = (offsets[doc] + pos)[:, None] + np.arange(-BACK, LENGTH)[None, :]
    real = (np.arange(-BACK, LENGTH)[None, :] >= -left[:, None]) & (np.arange(-BACK, LENGTH)[None, :] < right[:, None])
    ctx = np.where(real, data[np.clip(at, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)
    if bucket is None:
        shared = ctx[:, BACK - low : BACK + LENGTH - high].astype(np.uint64) + np.uint64(1)
        mixed = (shared * powers()[0][1 : shared.shape[1] + 1]).sum(axis=1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    whole = np.ascontiguousarray(np.concatenate([ctx, left.astype(np.uint8)[:, None], right.astype(np.uint8)[:, None]], axis=1))
    _, first, same = np.unique(whole.view(f"V{WIDTH + 2}").ravel(), return_index=True, return_inverse=True)
    earlier = ids[doc] > ids[doc[first[same]]]  # the same bytes in an earlier document of this batch
    bucket = np.where(earlier, (pos + ids[doc]) % buckets, bucket)  # what is decided may go anywhere
    made = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(ctx), [None, pa.py_buffer(np.ascontiguousarray(ctx))]).cast(pa.binary())
    made = pc.if_else(pa.array(earlier), pa.scalar(None, pa.binary()), made)
    out = pa.RecordBatch.from_arrays(
        [pa.array(bucket.astype(np.int32)), pa.array(ids[doc]), marks.take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), made],
        names=["bucket", "doc_id", "mark", "pos", "left", "right", "ctx"],
    )
    return out.filter(pa.array(left + right >= LENGTH))  # else no string fits


def bucket_runs(table: pa.Table) -> pa.Table:
    """One bucket's contexts -> (doc_id, mark, a, b): bytes that go."""
    table = table.combine_chunks()
    decided = table.filter(pc.is_null(table["ctx"]))
    rest = table.filter(pc.is_valid(table["ctx"]))
    made = [(decided, decided["pos"].to_numpy() - decided["left"].to_numpy(), decided["pos"].to_numpy() + decided["right"].to_numpy())]
    if rest.num_rows > 1:
        data = np.frombuffer(b"".join(rest["ctx"].to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
        far, near = repeated(data, rest["left"].to_numpy(), rest["right"].to_numpy(), rest["doc_id"].to_numpy())
        hit = np.flatnonzero(far >= 0)
        pos = rest["pos"].to_numpy()[hit]
        made.append((rest.take(pa.array(hit)), pos - far[hit], pos - near[hit] + LENGTH))
    return pa.concat_tables(
        [pa.table({"doc_id": t["doc_id"], "mark": t["mark"], "a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32))}) for t, a, b in made]
    )


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy, runs, text) -> the result."""
    for batch in batches:
        out = []
        for copy, runs, text in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
            n = len(text)
            gone = [[0, n]] if copy and n >= LENGTH else merge([(r["a"], r["b"]) for r in runs or []])
            digest, at = hashlib.sha256(), 0
            for a, b in gone:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            out.append((n, sum(b - a for a, b in gone), len(gone), digest.hexdigest()))
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def sampled_splitters(docs: DataFrame, rows: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(quantiles of the leading K bytes (three tokens) of anchors in a bounded sample of documents, those that fill two buckets or more)."""
    if buckets < 2:
        return np.empty(0, dtype=f"S{K}"), np.empty(0, dtype=f"S{K}")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            doc, pos, _ = anchors(data[: offsets[-1]], offsets)
            at = (offsets[doc] + pos)[:, None] + np.arange(K)[None, :]
            yield pa.RecordBatch.from_arrays([pa.array([bytes(r) for r in data[at]], pa.binary())], names=["kmer"])

    want = min(SAMPLE, 32 * buckets)
    share = min(1.0, max(500, want // 40) / max(rows, 1))  # documents with about a hundred anchors each
    some = docs.where(F.pmod(F.xxhash64("th", "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("th", "text")
    found = np.array([bytes(x) for x in some.mapInArrow(lead, "kmer binary").limit(8 * want).toPandas()["kmer"]], dtype=f"S{K}")
    if not len(found):
        return found, found
    found = np.sort(found)
    names, counts = np.unique(found, return_counts=True)
    return np.unique(found[np.linspace(0, len(found) - 1, buckets + 1).astype(np.int64)[1:-1]]), names[counts > max(8, 2 * len(found) // buckets)]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    bound_batches(spark)
    whole = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("th"), F.md5(whole).alias("mark"), whole.alias("text"))

    # texts: the earliest document of each; the others are copies
    slim = materialize(own.select("doc_id", "th", "mark", (F.octet_length("text") >= LENGTH).alias("long")).where("doc_id is not null"), "texts")
    first = slim.where("long").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("th").alias("th"), F.count("*").alias("n"))
    first = materialize(first, "firsts")

    # 1. anchors of more than one text
    group = W.partitionBy("key")
    # of texts with many copies only the first takes part; those with few copies are cut down to one a batch
    many = first.where(F.col("n") > MANY).select("mark", F.col("doc_id").alias("least"))
    alone = own.where("doc_id is not null").join(broadcast_if_small(materialize(many, "many")), "mark", "left").where("least is null or least = doc_id")
    found = alone.select("th", "text").mapInArrow(anchor_rows, "key long, th long, pos int, known boolean")
    shared = found.withColumn("low", F.min("th").over(group)).withColumn("high", F.max("th").over(group)).where("known or low < high")
    places = materialize(shared.groupBy("th").agg(F.collect_set("pos").alias("positions")), "anchors")

    # 2. contexts, and 3. their sorted buckets
    total = places.agg(F.sum(F.size("positions"))).first()[0] or 0
    buckets = int(min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-total // BUCKET))))
    rows = slim.count()
    splitters, hot = sampled_splitters(own, rows, buckets)
    wanted = first.join(places, "th").select("doc_id", "mark", "positions")
    texts = own.where("doc_id is not null").select("doc_id", "mark", "text").join(wanted, ["doc_id", "mark"])
    contexts = texts.select("doc_id", "mark", "positions", "text").mapInArrow(context_rows(splitters, hot), "bucket int, doc_id long, mark string, pos int, left int, right int, ctx binary")
    runs = contexts.groupBy("bucket").applyInArrow(bucket_runs, "doc_id long, mark string, a int, b int")
    runs = materialize(runs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "runs")

    # 4. copies lose all, others their runs
    known = lookup_hot(slim.where("long").select("doc_id", "mark"), first.select("mark", F.col("doc_id").alias("least"), "n"), "mark", "n", rows)
    copies = known.where("doc_id > least").select("doc_id", "mark", F.lit(True).alias("copy"))
    decided = runs.select("doc_id", "mark", F.lit(False).alias("copy"), "runs").unionByName(copies.distinct().withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType)))
    decided = materialize(decided, "decided")
    out = own.select("doc_id", "mark", "text").join(decided, ["doc_id", "mark"], "left").select("doc_id", F.coalesce("copy", F.lit(False)).alias("copy"), "runs", "text")
    return out.mapInArrow(cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
