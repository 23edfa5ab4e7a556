"""SimHash near-dedup with pivot distance tables.

A document's fingerprint is the bitwise majority of the hashes of its 3-word shingles. Equal fingerprints are one class
from then on: everything that follows sees each fingerprint once, however many copies there are.

Links (at most `RADIUS` differing bits) between different fingerprints: a table holds each fingerprint's Hamming
distances to `PIVOTS` reference fingerprints. Two fingerprints within the radius differ by no more than it in every such
coordinate, and they agree on at least one of RADIUS + 1 bit segments. So pairs meet on equal segments, those whose
largest coordinate difference is over the radius are discarded, and the survivors are verified bit by bit.

Segments that more than `CROWD` fingerprints share (near copies in thousands) would make pairs of a whole group. Their
fingerprints are linked another exact way: each names itself and its 64 neighbours at one bit; two fingerprints are
within two bits just if they name a common point, and no point is named by more than 65, so nothing grows with a group.

Components are found by star rounds over the links alone; documents join their class at the end.

Nulls: a null or empty text has fingerprint zero and is linked like any other. A row without an id takes part, and is
never a component's id unless no member has one. Repeated rows repeat. An empty table gives no rows. Ties: a bit set in just half
of the hashes is 0; of a component the smallest id stays, and of rows with that id the smallest hash of a text. Texts are hashed
whole, in time linear in their length, a batch's bytes at a time. Extra columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.llm.common import broadcast_if_small, connected_components, lookup_hot, map_texts, materialize, unused
from timberline.llm.similar import describe, similar_groups

SHINGLE, SEED, RADIUS, PIVOTS, CROWD = 3, 42, 2, 8, 48
#: Shingles turned into bits at once.
CHUNK = 1 << 15


def fingerprint(text: str | bytes | None) -> int:
    """Signed 64 bits. bytes.lower() and bytes.split() touch ASCII only, as wanted."""
    data = text.encode() if isinstance(text, str) else text
    words = data.lower().split() if data else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:], strict=False)]
    total = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype=">u8")
    for i in range(0, len(values), CHUNK):
        total += np.unpackbits(values[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes)).view(">i8")[0])


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of their numbers, so that every run has the same table."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i).encode(), SEED)).astype(np.int64)) for i in range(n)]


def bits_between(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def segments(fp: Column) -> list[Column]:
    """RADIUS + 1 runs of bits that together are all of them."""
    ends = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(ends, ends[1:], strict=False)]


def links(fps: DataFrame) -> DataFrame:
    """fps (fp), distinct -> (a, b), a < b: links that connect just what is within the radius."""
    coordinates = [bits_between(F.col("fp"), F.lit(p)).cast("byte").alias(f"d{i}") for i, p in enumerate(pivots())]
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("seg"), s.alias("key")) for i, s in enumerate(segments(F.col("fp")))])).alias("k")
    keyed = fps.select("fp", keys).select("fp", "k.seg", "k.key")
    crowds = keyed.groupBy("seg", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(crowds, ["seg", "key"]), "segments")  # a fingerprint alone in its segments goes here
    table = shared.where(F.col("n") <= CROWD).select("seg", "key", "fp", *coordinates)
    left, right = table.alias("x"), table.alias("y")
    near = reduce(lambda p, q: p & q, [F.abs(F.col(f"x.d{i}") - F.col(f"y.d{i}")) <= RADIUS for i in range(PIVOTS)])
    pairs = left.join(
        right, (F.col("x.seg") == F.col("y.seg")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near & (bits_between(F.col("x.fp"), F.col("y.fp")) <= RADIUS)
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    crowded = shared.where(F.col("n") > CROWD).select("fp").distinct()
    points = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << i).astype(np.int64)))) for i in range(64)])).alias("point")
    met = crowded.select("fp", points).groupBy("point").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")  # at most 65
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.unionAll(stars).distinct()


def fingerprints(docs: DataFrame, keep: dict[str, str], text: str) -> DataFrame:
    def make():
        return lambda texts: [(fingerprint(t),) for t in texts]

    return map_texts(docs, text, keep, "fp long", make)


def classes(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp) -> (fp, root, component_id, n): each fingerprint, its component and its smallest id, its own rows."""
    own = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    linked = connected_components(materialize(links(own.select("fp")), "links")).withColumnRenamed("node", "fp")
    rooted = materialize(own.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id", "n")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(fingerprints(docs, {"doc_id": doc_id}, text), "fingerprints")
    found = materialize(classes(prints).drop("root"), "components")
    out = lookup_hot(prints, found, "fp", "n", prints.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_heads(docs: DataFrame, rows: DataFrame, found: DataFrame, doc_id: str, hashed: str) -> DataFrame:
    """docs with one row of each component: the smallest id, then the smallest hash of the text.

    docs have the hash in the column `hashed`, which is dropped; rows are (doc_id, hash, node) of theirs; found is (node, root,
    component_id, n). The texts are not grouped: the rows that go are written first and joined against. Rows that agree in
    id and text are cut down to one by a window over those rows alone.
    """
    columns = [c for c in docs.columns if c != hashed]
    of, like, nth = unused(docs, "of"), unused(docs, "like"), unused(docs, "nth")
    named = lambda df: materialize(df.select(F.col("doc_id").alias(of), F.col("hash").alias(like)), "named")
    placed = materialize(lookup_hot(rows, found, "node", "n", rows.count()), "placed")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    heads = placed.where(first).groupBy("root").agg(F.min("hash").alias("head"))
    others = placed.where(first).join(heads, "root").where("hash <> head")
    gone = named(placed.where(~first).select("doc_id", "hash").unionAll(others.select("doc_id", "hash")).distinct())
    again = named(placed.where(first).groupBy("doc_id", "hash").count().where("count > 1"))
    same = docs[doc_id].eqNullSafe(F.col(of)) & (F.col(hashed) == F.col(like))
    left = docs.join(broadcast_if_small(gone), same, "left_anti")
    if again.isEmpty():
        return left.select(*columns)
    once = left.join(broadcast_if_small(again), same, "left_semi").withColumn(nth, F.row_number().over(W.partitionBy(doc_id, hashed).orderBy(hashed))).where(F.col(nth) == 1)
    return left.join(broadcast_if_small(again), same, "left_anti").select(*columns).unionByName(once.select(*columns))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of near_duplicates and the same columns."""
    hashed = unused(docs, "hash")
    keyed = docs.select("*", F.xxhash64(F.col(text)).alias(hashed))
    rows = materialize(fingerprints(keyed, {"doc_id": doc_id, "hash": hashed}, text).withColumnRenamed("fp", "node"), "fingerprints")
    found = materialize(classes(rows.select("doc_id", F.col("node").alias("fp"))).withColumnRenamed("fp", "node"), "components")
    return keep_heads(keyed, rows, found, doc_id, hashed)


def keep_one_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies (five-word shingles, similarity 0.8 or more) and the same columns.

    Fingerprints and `links` propose pairs, and whole sets of shingles decide about them. Fingerprints miss pairs at that
    similarity, so the exact filter of `similar` then finds those between the groups that are left. Texts of the same words are
    one node. Texts without words are one group.
    """
    hashed = unused(docs, "hash")
    keyed = docs.select("*", F.xxhash64(F.col(text)).alias(hashed))
    rows = materialize(describe(keyed, {"doc_id": doc_id, "hash": hashed}, text, fingerprint), "described")
    found = materialize(similar_groups(rows.drop("hash"), docs, text, links), "components")
    return keep_heads(keyed, rows.select("doc_id", "hash", "node"), found, doc_id, hashed)
