"""Groups of texts that are alike: sets of five-word shingles with a Jaccard similarity of 0.8 or more. Exact.

SimHash goes first: texts whose fingerprints are equal or linked (`simhash.links`) are verified on whole sets, and what these
pairs connect is a component, inside which no pair can matter any more.

Fingerprints cannot tell all: at similarity 0.8 two of them differ in some 10 of 64 bits, and what is reached by looking at
so many bits falls as a corpus grows. So the pairs between different components are found by prefix filter: in any fixed order
of all shingles, two sets of similarity 4/5 share one of the first `size // 5 + 1` shingles of each. Texts meet on those;
sizes, places in the order, the number of shingles that they meet on and the parities of their sets discard; whole sets
verify. Nothing depends on the size of the corpus and no pair is left out.

Parities: a set's shingles are dealt to PARITIES buckets and a bit says whether a bucket got an odd number. Two sets differ in
no fewer shingles than bits, so the bits of a pair bound its similarity from above, whatever the hashes are.

The order puts shingles that are frequent in a sample last, so that passages that many texts quote are rarely met on; which
ones these are changes the work, not the result.

A group of near copies would make all its pairs. First each text meets only the hub of a shingle: the text that shares most
with others, which an original does. What that links is one component. Then texts that share a shingle and lie in different
components are compared, in blocks, by sizes, places and parities, and make a row only if these let them be alike. Rows are
linear where a hub links a group. What is still quadratic are comparisons inside the join, of texts that share a shingle
with texts of other components; and rows, of texts of similarity near 0.8 that stay unlinked.

Batches are hashed in whole numpy passes, in time linear in their bytes. Shingles and sequences of words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from timberline.llm.common import bound_batches, buffers, connected_components, lookup_hot, materialize

WORDS, SIMILARITY, BLOCK = 5, 0.8, 64
#: The sample that orders the shingles: one text in up to SAMPLE; a shingle found in OFTEN of its texts is frequent; at most MOST.
SAMPLE, OFTEN, MOST = 20, 4, 1 << 17
#: Words hashed at once; weights kept in a table.
RUN, TABLE = 1 << 14, 256
#: Of a shingle's hash; a batch has at most 512 documents.
HASH_BITS = 55
#: Buckets of the parities, a multiple of 64: they tell sets of up to some 900 shingles apart.
PARITIES = 512
#: Bits of the filter of texts whose sets are wanted, at most: 16 MB. It only spares work, so it may fill up.
FILTER_BITS = 1 << 27

ODD = np.uint64(0xD6E8FEB86659FD93)
#: What a byte counts for in a word: 0 for white space; A-Z count as a-z.
VALUE = np.arange(1, 257, dtype=np.uint64)
VALUE[ord("A") : ord("Z") + 1] += np.uint64(32)
VALUE[[9, 10, 11, 12, 13, 32]] = 0


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def weights(n: int, first: int = 0) -> np.ndarray:
    """Odd pseudo-random factors for places first, first + 1, ..."""
    return scramble(np.arange(first + 1, first + n + 1, dtype=np.uint64) * ODD) | np.uint64(1)


SMALL = weights(TABLE)


def factors(places: np.ndarray) -> np.ndarray:
    out = SMALL[np.minimum(places, TABLE - 1)]
    far = np.flatnonzero(places >= TABLE)
    if len(far):
        out[far] = scramble((places[far].astype(np.uint64) + np.uint64(1)) * ODD) | np.uint64(1)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of each document's first word and of the end) for documents side by side in data at offsets."""
    base, data = int(offsets[0]), data[int(offsets[0]) : int(offsets[-1])]
    ends = offsets - base
    inside = VALUE[data] != 0
    fresh = np.ones(len(data) + 1, dtype=bool)  # no word goes on from the byte before
    fresh[1:-1] = ~inside[:-1]
    fresh[ends] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    out = np.empty(len(starts), dtype=np.uint64)
    for a in range(0, len(starts), RUN):
        b = min(a + RUN, len(starts))
        low, high = int(starts[a]), int(starts[b]) if b < len(starts) else len(data)
        at = starts[a:b] - low
        places = np.arange(high - low) - np.repeat(at, np.diff(at, append=high - low))
        out[a:b] = np.add.reduceat(VALUE[data[low:high]] * factors(places), at)
    return scramble(out), np.searchsorted(starts, ends)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each distinct shingle, ordered by both; a document of fewer words is one shingle.

    Hashes keep HASH_BITS bits, so that a document's number fits above them and one sort of plain numbers does.
    """
    counts, mix = np.diff(firsts), weights(WORDS)
    if len(counts) > 1 << (64 - HASH_BITS):
        raise ValueError("too many documents at once")
    found = [np.empty(0, dtype=np.uint64)]
    numbers = np.arange(len(counts), dtype=np.uint64) << np.uint64(HASH_BITS)
    if len(words) >= WORDS:
        whole = words[: len(words) - WORDS + 1] * mix[0]
        for i in range(1, WORDS):
            whole += words[i : len(words) - WORDS + 1 + i] * mix[i]
        room = np.repeat(firsts[1:], counts)[: len(whole)] - np.arange(len(whole)) >= WORDS
        number = np.repeat(numbers, counts)[: len(whole)]
        found.append((scramble(whole) >> np.uint64(64 - HASH_BITS) | number)[room])
    for d in np.flatnonzero((counts > 0) & (counts < WORDS)):
        own = words[firsts[d] : firsts[d + 1]]
        whole = np.array([(own * mix[: len(own)]).sum() + np.uint64(len(own))], dtype=np.uint64)
        found.append(scramble(whole) >> np.uint64(64 - HASH_BITS) | numbers[d])
    both = np.sort(np.concatenate(found))
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    return (both >> np.uint64(HASH_BITS)).astype(np.int64), (both & np.uint64((1 << HASH_BITS) - 1)).view(np.int64)


def node_hashes(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One hash of each document's sequence of words; 0 for none."""
    counts = np.diff(firsts)
    places = np.arange(len(words)) - np.repeat(firsts[:-1], counts)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * factors(places), dtype=np.uint64)])
    return scramble(sums[firsts[1:]] - sums[firsts[:-1]]).view(np.int64)


def lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """values, ordered by doc, as a list a document."""
    ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def leading(doc: np.ndarray, h: np.ndarray, n: int, frequent: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, pa.ListArray]:
    """(distinct shingles of each document, the first ones in order). frequent: sorted hashes of frequent shingles and their counts."""
    sizes = np.bincount(doc, minlength=n)
    if frequent is not None and len(frequent[0]) and len(h):
        at = np.minimum(np.searchsorted(frequent[0], h), len(frequent[0]) - 1)
        often = np.where(frequent[0][at] == h, frequent[1][at], 0)
        if often.any():
            order = np.argsort(often, kind="stable")
            order = order[np.argsort(doc[order], kind="stable")]
            h = h[order]
    nth = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    first = nth < sizes[doc] // WORDS + 1
    return sizes, lists(doc[first], h[first], n)



def parities(doc: np.ndarray, h: np.ndarray, n: int) -> pa.ListArray:
    """PARITIES bits of each document, as longs: whether an odd number of its shingles falls into a bucket."""
    odd = np.bincount(doc * PARITIES + h % PARITIES, minlength=n * PARITIES) & 1
    return lists(np.repeat(np.arange(n), PARITIES // 64), np.packbits(odd.astype(np.uint8)).view(np.int64), n)


def map_words(docs: DataFrame, keep: dict[str, str], text: str, fields: str, make: Callable[[], Callable[[np.ndarray, np.ndarray, pa.Array], list]]) -> DataFrame:
    """keep (new name -> column) beside `fields`, columns made of a batch's (word hashes, firsts, texts as bytes); make() runs once a task.

    Behind the columns may come a mask of the rows that stay.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(*[F.col(c).alias(n) for n, c in keep.items()], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("bytes of the text"))
    added = T.StructType.fromDDL(fields)
    names = [*keep, *[f.name for f in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            words, firsts = word_hashes(*buffers(batch.column(batch.num_columns - 1)))
            made = work(words, firsts, batch.column(batch.num_columns - 1))
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], *made[: len(added)]], names=names)
            yield out.filter(made[len(added)]) if len(made) > len(added) else out

    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], *added.fields]))


def frequent_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of what many texts of a sample hold. At most MOST come to the driver."""

    def make():
        return lambda words, firsts, texts: [lists(*shingle_hashes(words, firsts), len(texts))]

    one_in = max(1, min(SAMPLE, docs.count() // 5_000))
    some = docs.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(text)), F.lit(one_in)) == 0)
    counted = map_words(some, {}, text, "held array<long>", make).select(F.explode("held").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    table = counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "key").limit(MOST).toArrow()
    key, n = (table.column(c).to_numpy() for c in ("key", "n"))
    turn = np.argsort(key)
    return key[turn].astype(np.int64), n[turn].astype(np.int64)


def describe(docs: DataFrame, keep: dict[str, str], text: str, printed: Callable[[bytes], int]) -> DataFrame:
    """keep beside node (hash of the words), fp (printed), size (distinct shingles), keys (the first of them in order) and odd (parities)."""
    frequent = frequent_shingles(docs, text)

    def make():
        def work(words, firsts, texts):
            n, (doc, h) = len(texts), shingle_hashes(words, firsts)
            sizes, keys = leading(doc, h, n, frequent)
            fp = pa.array([printed(t) for t in texts.to_pylist()], pa.int64())
            return [pa.array(node_hashes(words, firsts)), fp, pa.array(sizes.astype(np.int32)), keys, parities(doc, h, n)]

        return work

    return map_words(docs, keep, text, "node long, fp long, size int, keys array<long>, odd array<long>", make)


def aligned(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of sizes n and m that share a shingle at places i and j can be alike: 4/9 of both sizes must be common."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * (F.least(i, j) + 1 + F.least(n - 1 - i, m - 1 - j)) >= 4 * (n + m))


def enough(shared: Column, n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets that first meet at places i and j and share so many of their first shingles can be alike.

    The set whose first shingles end earlier in the order shares no more than these and all its others.
    """
    rest = lambda size: size - F.floor(size / WORDS) - 1
    return (9 * (1 + F.least(n - 1 - i, m - 1 - j)) >= 4 * (n + m)) & (9 * (shared + F.greatest(rest(n), rest(m))) >= 4 * (n + m))


def not_too_odd(a: str, b: str) -> Column:
    """Whether the parities of structs or tables a and b (size, odd) let them be alike: only a ninth of both sizes may differ."""
    apart = [F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(PARITIES // 64)]
    return 9 * sum(apart[1:], apart[0]) <= F.col(f"{a}.size") + F.col(f"{b}.size")


def printed_pairs(nodes: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes (node, fp, size, odd) -> (a, b), a > b: each node with the least of its fingerprint, and the least ones of linked fingerprints."""
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "prints")
    same = lookup_hot(nodes.select("node", "fp"), least, "fp", "n", nodes.count()).select("node", "least")
    at = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    linked = links(least.select("fp")).join(at("a"), "a").join(at("b"), "b").select("a_node", "b_node")
    both = same.where("node <> least").unionAll(linked).toDF("a", "b")
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def meetings(nodes: DataFrame) -> DataFrame:
    """nodes (node, size, keys, root) -> (key, node, size, pos, root, n, hub) for each key that n nodes of several roots share."""
    own = W.partitionBy("key")
    keys = nodes.select("node", "size", "root", F.posexplode("keys").alias("pos", "key"))
    several = F.min("root").over(own) < F.max("root").over(own)
    shared = materialize(keys.withColumn("n", F.count("*").over(own)).withColumn("several", several).where("several").drop("several"), "shared")
    score = shared.groupBy("node").agg(F.sum("n").alias("score"))
    return shared.join(score, "node").withColumn("hub", F.max(F.struct("score", "node", "size", "pos", "root")).over(own)).drop("score")


def counted_pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """rows of a shingle each, of structs x and y (node, size, pos) -> (a, b), a > b: the pairs that share enough to be alike."""
    turn = F.col(f"{x}.node") > F.col(f"{y}.node")
    side = lambda c, up: F.when(turn if up else ~turn, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    own = rows.select(side("node", True).alias("a"), side("node", False).alias("b"), side("size", True).alias("n"), side("size", False).alias("m"), side("pos", True).alias("i"), side("pos", False).alias("j"))
    found = own.groupBy("a", "b", "n", "m").agg(F.count("*").alias("shared"), F.min("i").alias("i"), F.min("j").alias("j"))
    return found.where(enough(*[F.col(c) for c in ("shared", "n", "i", "m", "j")])).select("a", "b")


def hub_pairs(met: DataFrame) -> DataFrame:
    """(a, b), a > b: each node with the hubs of its keys, where they are of different roots and what they share as node and hub is enough."""
    near = met.where((F.col("root") != F.col("hub.root")) & aligned(F.col("size"), F.col("pos"), F.col("hub.size"), F.col("hub.pos")))
    return counted_pairs(near.select(F.struct("node", "size", "pos").alias("x"), F.col("hub").alias("y")), "x", "y")


def meeting_pairs(met: DataFrame, linked: DataFrame, odds: DataFrame) -> DataFrame:
    """Structs x and y for each shingle on which a pair meets that lies in different components of linked and may be alike."""
    own = W.partitionBy("key")
    placed = met.drop("root").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.withColumn("home", F.max(F.when(F.col("node") == F.col("hub.node"), F.col("root"))).over(own)).drop("hub")
    stray = F.col("root") != F.col("home")
    mixed = placed.withColumn("strays", F.sum(stray.cast("long")).over(own)).where("strays > 0")
    mixed = materialize(mixed.join(odds.select("node", "odd"), "node"), "mixed")
    blocks = F.ceil(F.col("n") / BLOCK)
    left = mixed.where(stray).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).alias("x")
    right = mixed.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).alias("y")
    once = (F.col("y.root") == F.col("y.home")) | (F.col("x.node") < F.col("y.node"))
    apart = (F.col("x.root") != F.col("y.root")) & aligned(F.col("x.size"), F.col("x.pos"), F.col("y.size"), F.col("y.pos"))
    return left.join(right, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & once & apart & not_too_odd("x", "y"))


def other_pairs(met: DataFrame, linked: DataFrame, done: DataFrame, odds: DataFrame) -> DataFrame:
    """(a, b), a > b: all pairs that may be alike, lie in different components of linked and are not in done."""
    return counted_pairs(meeting_pairs(met, linked, odds), "x", "y").join(done, ["a", "b"], "left_anti")


def wanted_filter(nodes: DataFrame) -> np.ndarray:
    """A bit table of nodes, 16 bits a node up to FILTER_BITS; the driver gets its words, not the nodes."""
    bits = 1 << max(12, min(FILTER_BITS.bit_length() - 1, (16 * nodes.count()).bit_length()))
    at = F.pmod(F.col("node"), F.lit(bits))
    words = nodes.select(F.shiftright(at, 5).alias("i"), F.expr(f"shiftleft(1L, cast(pmod(node, {bits}) & 31 AS INT))").alias("w")).groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()
    table = np.zeros(bits >> 5, dtype=np.uint32)
    table[words.column("i").to_numpy()] = words.column("w").to_numpy().astype(np.uint32)
    return table


def shingle_sets(docs: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """(node, held: sorted hashes of all its distinct shingles) of the nodes (node); other texts do not leave their task, but for a few."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted_filter(nodes))

    def make():
        table = shared.value
        low = np.int64(len(table) * 32 - 1)

        def work(words, firsts, texts):
            n = len(texts)
            node = node_hashes(words, firsts)
            at = node & low
            stays = (table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
            doc, h = shingle_hashes(words, firsts)
            some = stays[doc]
            ends = np.searchsorted(doc[some], np.arange(n + 1)) * 8
            held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h[some]))])
            return [pa.array(node), held, pa.array(stays)]

        return work

    some = map_words(docs, {}, text, "node long, held binary", make)
    # copies of a text: one a task is chosen before the shuffle
    return some.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("held").alias("held"))


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two whole sets of shingles."""
    x, y = np.frombuffer(a, dtype=np.int64), np.frombuffer(b, dtype=np.int64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def verified(pairs: DataFrame, docs: DataFrame, text: str, odds: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are alike. Parities (odds: node, size, odd) spare fetching some sets."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            alike = [likeness(x, y) >= SIMILARITY for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    known = lambda c: odds.select(F.col("node").alias(c), F.struct("size", "odd").alias(f"of_{c}"))
    pairs = materialize(pairs.join(known("a"), "a").join(known("b"), "b").where(not_too_odd("of_a", "of_b")).select("a", "b"), "possible")
    nodes = materialize(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "wanted")
    sets = materialize(shingle_sets(docs, text, nodes), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("held").alias("s"))
    two = sets.select(F.col("node").alias("b"), F.col("held").alias("t"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def similar_groups(rows: DataFrame, docs: DataFrame, text: str, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (doc_id, node, fp, size, keys, odd) of docs -> (node, root, component_id, n): each node's group, its smallest id, the node's rows.

    links: of distinct fingerprints (fp), pairs (a, b) that connect those near each other.
    """
    firsts = [F.first(c).alias(c) for c in ("fp", "size", "keys", "odd")]
    nodes = materialize(rows.groupBy("node").agg(*firsts, F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    check = lambda pairs: materialize(verified(pairs, docs, text, nodes), "alike")
    linked = connected_components(check(printed_pairs(nodes, links)))
    placed = nodes.select("node", "size", "keys").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = materialize(meetings(placed), "met")
    pairs = materialize(hub_pairs(met), "pairs")
    linked = joined_components(linked, check(pairs))
    more = materialize(other_pairs(met, linked, pairs, nodes), "pairs")
    if not more.isEmpty():
        linked = joined_components(linked, check(more))
    rooted = materialize(nodes.select("node", "least", "n").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("node", "root", "component_id", "n")


def joined_components(linked: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after further edges (a, b): only the components that these touch are walked again."""
    at = lambda c: linked.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    roots = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    above = connected_components(roots).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = linked.join(above, linked["root"] == above["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    # texts that no edge touched before are roots of their own
    alone = above.join(linked, above["old"] == linked["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return materialize(moved.unionAll(alone), "linked")
