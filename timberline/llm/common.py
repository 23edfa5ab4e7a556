"""What the corpus operators share: scratch tables, batch bounds, joins on hot keys, connected components.

Scratch tables are Parquet under ``spark.checkpoint.dir``, which every executor and the driver can reach, so a lost
executor costs a re-read and not a recomputation of everything before.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows in one Arrow batch to Python: long texts stay bounded in a worker's memory.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a folder of our own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.timberline.scratch", None)
    if not root:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            root = tempfile.mkdtemp(prefix="timberline-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
            if re.match(r"(file:)?/", root):
                raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; the warehouse {root} may be a local one")
        spark.conf.set("spark.timberline.scratch", root)
    return root.rstrip("/")


#: Spark drops a query's shuffle files as soon as the query ends.
SHED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and is computed once.

    Its shuffle files go when it is written and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/timberline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHED, None)
    spark.conf.set(SHED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHED) if before is None else spark.conf.set(SHED, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows that are broadcast at most: with a few numbers each, under 64 MB.
BROADCAST_ROWS = 500_000


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most BROADCAST_ROWS of them; more are joined by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batch limits to at most these; a smaller setting of the user stays."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        now = int(now.rstrip("bB")) if now and now.rstrip("bB").isdigit() else 0
        if now <= 0 or now > value:
            spark.conf.set(key, str(value))


def map_texts(df: DataFrame, text: str, keep: dict[str, str], fields: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """keep (new name -> column) as it is, beside what Python makes of each text.

    make() runs once a task and gives a function from a batch's texts (None for null) to one tuple of `fields` a text.
    """
    bound_batches(df.sparkSession)
    own = df.select(*[F.col(c).alias(n) for n, c in keep.items()], F.col(text).alias(unused(df.select(*keep.values()).toDF(*keep) if keep else df, "text")))  # taken by its place
    added = T.StructType.fromDDL(fields)
    names, kinds = [f.name for f in added], [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            rows = work(batch.column(batch.num_columns - 1).to_pylist())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, *names])

    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], *added.fields]))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column, nothing copied."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)), at


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup_hot(rows: DataFrame, table: DataFrame, key: str, counts: str, total: int) -> DataFrame:
    """rows LEFT JOIN table USING (key), where some keys of rows may be very frequent.

    table has one row a key and its number of rows in the column `counts`. Keys that hold over 1/1000 of all rows
    (so at most 1,000 keys) are looked up by broadcast; the rest by a shuffle in which no key is hot.
    """
    floor = max(1_000, total // 1000)
    hot = table.where(F.col(counts) > floor).drop(counts)
    if hot.isEmpty():
        return rows.join(table.drop(counts), key, "left")
    own, known = [c for c in table.columns if c not in (key, counts)], unused(rows, "known")
    first = rows.join(F.broadcast(hot.withColumn(known, F.lit(True))), key, "left")
    found = first.where(F.col(known)).drop(known)
    rest = first.where(F.col(known).isNull()).drop(known, *own)
    return found.unionByName(rest.join(table.where(F.col(counts) <= floor).drop(counts), key, "left"))


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """edges (a, b) of longs -> (node, root): the smallest node of each component. Nodes without edges are absent.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each written to the shared folder. Every round
    is two aggregations by node; stars end when no edge changes, after O(log^2) rounds.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        return (
            down.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = sign(now)
    if mark[0]:
        for _ in range(most_rounds):
            now = materialize(star(star(now, True), False), "stars")
            was, mark = mark, sign(now)
            if was == mark:
                break
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
