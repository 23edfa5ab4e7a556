"""Exact top-k search by inner product over a pivot-distance index.

Vectors are turned into integers. To search by distance, each vector x of length |x| <= M is thought of with one more
coordinate sqrt(M^2 - |x|^2), and a query q with 0 there: |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>, so the nearest are those
of the highest inner product, and the triangle inequality holds whatever the lengths.

Index: every vector is keyed by its nearest pivot and the distance to it. Pivots are drawn from a bounded sample
(`SAMPLE` rows) farthest-first. Range partitions over (pivot, distance, id) cut the rows into even blocks of sorted
annuli, also where one vector is repeated over a third of the rows.

Search: a query's home block gives it a first bound while the index is built. A table of the annuli of each part (a row a part
and pivot) then tells, by the triangle inequality, which parts can hold anything better; a query is sent to those alone, and
a part only to chunks of queries that need it. Chunks are made of queries that live close together. A tile, a part and a
chunk, holds at most `TILE_BYTES` of either, so nothing is collected and memory does not grow with the table. Inside a tile
each query starts at the annulus next to its own distance and goes outwards; it stops where the triangle inequality puts all
that is left beyond its k-th best so far. Scores are exact integers. Where distances tell little (many dimensions, no
clusters), bounds rule out little and the work is that of comparing all queries with all rows, tile by tile.

Nulls: vectors that are null, hold a null or a non-finite component, or have another length than most take no part, and
neither do rows without an id. Repeated rows are candidates of their own, but a query's own id is left out. Components
must stay below 2^24 after scaling, or scores would be no exact floats; larger ones raise. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.llm.common import bound_batches, materialize

SCALE, TOP, PIVOTS, SAMPLE = 1024.0, 10, 32, 4096
#: Rows of a block; vectors and queries of a tile, and bytes of either.
BLOCK, LEAST_ROWS, MOST_ROWS, QUERIES, TILE_BYTES = 512, 8192, 131_072, 4096, 32 << 20
SLACK = 1e-6


def integers(rows: pd.Series) -> np.ndarray:
    x = np.floor(np.stack(rows.to_numpy()).astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() >= 1 << 24:
        raise ValueError("a component is too large for exact scores")
    return x


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before."""
    if not len(sample):
        return sample
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """x with the coordinate that makes all lengths equal to `longest`."""
    rest = np.maximum(longest**2 - (x**2).sum(axis=1), 0)
    return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest with all ties ordered by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = scores >= least
        scores, ids = scores[over], ids[over]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def highest(to_pivot: np.ndarray, norms: np.ndarray, pivot: np.ndarray, near: np.ndarray, far: np.ndarray, longest: float) -> np.ndarray:
    """The highest score (with slack) that a vector of each annulus can have with each query: queries by annuli."""
    d = to_pivot[:, pivot]
    gap = np.maximum(np.maximum(near[None, :] - d, d - far[None, :]), 0) * (1 - SLACK) - SLACK
    return (norms[:, None] + longest**2 - np.maximum(gap, 0) ** 2) / 2 + 1


def chunks_of(counts: list[tuple[int, int]], most: int) -> dict[int, tuple[int, int]]:
    """(part, queries) in order -> part: (first chunk, chunks over which its queries are dealt). Small neighbours share a chunk."""
    out, chunk, room = {}, 0, most
    for part, n in counts:
        if n > room and room < most:
            chunk, room = chunk + 1, most
        several = max(1, -(-n // most))
        out[part] = chunk, several
        chunk, room = (chunk + several, most) if several > 1 else (chunk, room - n)
    return out


def search_tile(queries: pd.DataFrame, blocks: pd.DataFrame, longest: float, dims: int, k: int) -> Iterator[tuple[int, int, float]]:
    """(query id, vector id, score): each query's k best of the tile's blocks, less what its bound rules out."""
    q = np.stack([np.frombuffer(b, dtype=np.float64) for b in queries["v"]])
    to_pivot = np.stack([np.frombuffer(b, dtype=np.float64) for b in queries["to_pivots"]])
    ids, floor = queries["id"].to_numpy(), queries["floor"].to_numpy()
    norms = (q**2).sum(axis=1)
    annuli = [(np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.vectors, dtype=np.int32).reshape(-1, dims)) for r in blocks.itertuples(index=False)]
    most = highest(to_pivot, norms, blocks["pivot"].to_numpy(), blocks["near"].to_numpy(), blocks["far"].to_numpy(), longest)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, dtype=np.int64))] * len(q)
    bound = floor.copy()
    # Annuli in the order in which any query can score highest; the queries that still need one are scored at once.
    for a in np.argsort(-most.max(axis=0), kind="stable"):
        need = np.flatnonzero(most[:, a] >= bound)
        if not len(need):
            continue
        own, vectors = annuli[a]
        scores = q[need] @ vectors.astype(np.float64).T
        scores[own[None, :] == ids[need][:, None]] = -np.inf
        for row, i in zip(scores, need, strict=True):
            over = row >= max(bound[i], -1e300)
            if over.any():
                s, v = best_of(np.concatenate([best[i][0], row[over]]), np.concatenate([best[i][1], own[over]]), k)
                best[i] = s, v
                if len(s) == k:
                    bound[i] = max(bound[i], s[-1])
    for i, (s, v) in enumerate(best):
        for x, y in zip(s, v, strict=True):
            yield int(ids[i]), int(y), x


def search(vectors: DataFrame, every: int = 100, k: int = TOP, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by `every`, the k other rows of the highest score."""
    spark = vectors.sparkSession
    bound_batches(spark, 2048)
    e = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(good).select(F.col(vec_id).cast("long").alias("id"), e.alias("v")).where("size(v) > 0")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * SCALE), F.lit(2)))).alias("m")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score long"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims, n, longest = int(sizes["d"]), int(sizes["n"]), float(np.sqrt(sizes["m"])) + 1.0
    rows = rows.where(F.size("v") == dims)
    share = min(1.0, SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * SAMPLE).toPandas()
    pivots = lifted(farthest_first(integers(drawn["v"]) if len(drawn) else np.zeros((1, dims)), PIVOTS), longest)

    # key every vector by nearest pivot and distance
    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = integers(b["v"])
            d = distances(lifted(x, longest), pivots)
            near = d.argmin(axis=1)
            yield pd.DataFrame({"id": b["id"], "pivot": near.astype(np.int32), "dist": d[np.arange(len(x)), near], "v": [r.tobytes() for r in x.astype(np.int32)]})

    parts = min(int(np.clip(-(-n // 12), LEAST_ROWS, MOST_ROWS)), max(BLOCK, TILE_BYTES // (4 * dims)))
    parts = max(1, -(-n // parts))
    keyed = rows.mapInPandas(key, "id long, pivot int, dist double, v binary").repartitionByRange(parts, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")

    # blocks of annuli, and the queries among their rows with a first bound from their own block
    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                b = batch.iloc[at : at + BLOCK]
                x = np.stack([np.frombuffer(v, dtype=np.int32) for v in b["v"]]).astype(np.float64)
                ids, out = b["id"].to_numpy(), []
                for p, own in b.groupby("pivot", sort=True).indices.items():
                    dist = b["dist"].to_numpy()[own]
                    out.append((False, int(p), float(dist.min()), float(dist.max()), ids[own].tobytes(), x[own].astype(np.int32).tobytes(), None))
                asks = np.flatnonzero(ids % every == 0)
                if len(asks):
                    # a query's lifted coordinate is 0; its distances to the pivots use that
                    to = distances(np.concatenate([x[asks], np.zeros((len(asks), 1))], axis=1), pivots)
                    scores = x[asks] @ x.T
                    scores[ids[None, :] == ids[asks][:, None]] = -np.inf
                    for i, row in enumerate(scores):
                        floor = float(np.partition(row, len(row) - k)[len(row) - k]) if len(row) >= k else -np.inf
                        out.append((True, 0, floor, 0.0, ids[asks[i]].tobytes(), x[asks[i]].tobytes(), to[i].tobytes()))
                yield pd.DataFrame(out, columns=["query", "pivot", "near", "far", "ids", "vectors", "to_pivots"])

    built = materialize(keyed.mapInPandas(block, "query boolean, pivot int, near double, far double, ids binary, vectors binary, to_pivots binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))), "annuli")
    blocks = built.where("not query").select("part", "pivot", "near", "far", "ids", "vectors")
    rings = blocks.groupBy("part", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far")).toPandas()  # a row a part, and a pivot
    homes = built.where("query").groupBy("part").count().orderBy("part").collect()  # a row a part
    places = chunks_of([(r["part"], r["count"]) for r in homes], min(QUERIES, max(1, TILE_BYTES // (8 * dims))))
    shared = spark.sparkContext.broadcast((rings["part"].to_numpy(), rings["pivot"].to_numpy(), rings["near"].to_numpy(), rings["far"].to_numpy(), places))

    # each query beside the parts that can hold something better than its bound
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, pivot, near, far, chunk = shared.value
        for b in batches:
            if not len(b):
                continue
            v = np.stack([np.frombuffer(x, dtype=np.float64) for x in b["vectors"]])
            most = highest(np.stack([np.frombuffer(x, dtype=np.float64) for x in b["to_pivots"]]), (v**2).sum(axis=1), pivot, near, far, longest)
            floor = b["near"].to_numpy()
            made = []
            for i, r in enumerate(b.itertuples(index=False)):
                first, several = chunk[r.part]
                made += [(int(p), first + r.spread % several, r.ids, floor[i], v[i].tobytes(), r.to_pivots) for p in np.unique(part[most[i] >= floor[i]])]
                if len(made) >= 2048 or i + 1 == len(b):
                    yield pd.DataFrame(made, columns=["part", "chunk", "ids", "floor", "v", "to_pivots"])
                    made = []

    spread = F.pmod(F.xxhash64("ids", F.monotonically_increasing_id()), F.lit(1 << 30)).alias("spread")
    asked = built.where("query").select("part", "near", "ids", "vectors", "to_pivots", spread).mapInPandas(send, "part int, chunk int, ids binary, floor double, v binary, to_pivots binary")
    asked = materialize(asked, "asked")
    tiles = blocks.join(asked.select(F.col("part").alias("to"), F.col("chunk").alias("by")).distinct(), F.col("part") == F.col("to"))

    def tile(queries: pd.DataFrame, annuli: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(annuli):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        queries = queries.assign(id=[int(np.frombuffer(x, dtype=np.int64)[0]) for x in queries["ids"]])
        found = list(search_tile(queries, annuli, longest, dims, k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = asked.groupBy("part", "chunk").cogroup(tiles.groupBy("to", "by")).applyInPandas(tile, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
