"""Variables in long form, their types, cardinalities and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A value that prints again as it was read, below 2^31.
CANONICAL = r"^(?:0|[1-9][0-9]{0,9})$"


def is_numeric(v: Column) -> Column:
    return F.when(v.rlike(CANONICAL), v.cast("bigint") < 2147483648).otherwise(False)


def long_form(matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, eid, rec_id, pos, value): one row a variable."""
    return matched.where("eid > 0").select(*keys, "eid", "rec_id", F.posexplode("vars").alias("pos", "value"))


def profile(variables: DataFrame) -> DataFrame:
    """(eid, pos, kind, n_distinct): num if every value is numeric."""
    return variables.groupBy("eid", "pos").agg(F.when(F.bool_and(is_numeric(F.col("value"))), "num").otherwise("str").alias("kind"), F.count_distinct("value").alias("n_distinct"))


def roles(profiled: DataFrame, share: float = 0.8) -> DataFrame:
    """profile with rank by cardinality and is_op: the lowest-cardinality columns (a fifth, and one) stay as they are."""
    by = W.partitionBy("eid")
    rank = F.row_number().over(by.orderBy("n_distinct", "pos"))
    fixed = F.floor(F.count("*").over(by) * F.lit(1 - share)) + 1
    return profiled.withColumn("rank", rank).withColumn("is_op", F.col("rank") > fixed)


def identifiers(with_roles: DataFrame, most: int = 3) -> DataFrame:
    """(eid, pos, nth): the first string columns that vary serve as identifiers."""
    nth = F.row_number().over(W.partitionBy("eid").orderBy("pos"))
    return with_roles.where("is_op AND kind = 'str'").withColumn("nth", nth).where(F.col("nth") <= most).select("eid", "pos", "nth")


def small_groups(variables: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, eid, n, bypass): whether a template has too few rows in a block for its rules."""
    counted = variables.where("pos = 0").groupBy(*keys, "eid").agg(F.count("*").alias("n"))
    return counted.withColumn("bypass", F.col("n") < least)


def dictionary(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, dict_id): ordinals from 0 by a value's first place within keys. Ranks run over distinct values only."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("first"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("first", value)) - 1
    return first.select(*keys, value, nth.alias("dict_id"))
