"""Template match: broadcast hash joins on the token count and the first token, first template by order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.config import LogConfig
from timberline.operators import tokens as tk


def template_table(spark: SparkSession, templates: list[tuple[int, int, list[str], int]]) -> DataFrame:
    """(eid, ord, tokens, train_count) -> the table of templates with lengths and wildcard counts."""
    return described(spark.createDataFrame(templates, "eid int, ord int, tokens array<string>, train_count long"))


def described(rows: DataFrame) -> DataFrame:
    return rows.select("eid", "ord", "tokens", F.size("tokens").alias("n_tokens"), F.size(F.filter("tokens", lambda t: t == tk.WILD)).alias("n_vars"), "train_count")


def match(parsed: DataFrame, templates: DataFrame, config: LogConfig, large: bool = False) -> DataFrame:
    """parsed (.., status, toks) -> with eid and vars: eid > 0 matched, 0 match failed, -1 load failed.

    Templates of one length and first token are one row of the broadcast side, in order, and those that begin with a
    wildcard are a row for each length. So a record meets two rows and no aggregation has to pick among several hits; the
    first that fits is found inside them. The model bounds templates in number and length (`LogConfig.max_templates`, `max_tokens`).

    large: templates that the driver need not hold. Those without wildcards are equal to what they fit, so they are joined by a
    hash of their tokens in a shuffle; the others go as above, but are broadcast only if Spark finds them small.
    """
    whole, hint = [], F.broadcast
    if large:
        plain = templates.where("n_vars = 0").groupBy("tokens").agg(F.min(F.struct("ord", "eid")).alias("t"))
        hit = F.struct("t.ord", "t.eid", "tokens", F.lit(0).alias("n_vars")).alias("whole")
        parsed = parsed.withColumn("tokens_hash", F.xxhash64("toks"))
        plain = plain.select(F.xxhash64("tokens").alias("template_hash"), hit)
        parsed = parsed.join(plain, (F.col("tokens_hash") == F.col("template_hash")) & (F.col("toks") == F.col("whole.tokens")), "left").drop("tokens_hash", "template_hash")
        templates, whole, hint = templates.where("n_vars > 0"), [F.col("whole")], lambda table: table
    anchor = F.get("tokens", F.lit(0))
    bucket = F.array_sort(F.collect_list(F.struct("ord", "eid", "tokens", "n_vars")))
    fixed = templates.where(anchor != tk.WILD).groupBy("n_tokens", anchor.alias("anchor")).agg(bucket.alias("fixed"))
    free = templates.where(F.coalesce(anchor, F.lit(tk.WILD)) == tk.WILD).groupBy("n_tokens").agg(bucket.alias("free"))
    joined = parsed.withColumn("n_tokens", F.size("toks")).withColumn("anchor", F.get("toks", F.lit(0)))
    joined = joined.join(hint(fixed), ["n_tokens", "anchor"], "left").join(hint(free), "n_tokens", "left")
    ok = F.col("status") == "ok"
    first = [F.get(F.filter(b, lambda t: tk.fits(F.col("toks"), t["tokens"])), F.lit(0)) for b in ("fixed", "free")]
    found = joined.withColumn("hit", F.when(ok & (F.col("n_tokens") < config.max_tokens), F.least(*whole, *first)))
    final = (
        F.when(~ok, F.col("status"))
        .when(F.col("n_tokens") >= config.max_tokens, "load_failed:too_many_token")
        .when(F.col("hit").isNull(), "match_failed")
        .when(F.col("hit.n_vars") > config.max_vars, "load_failed:too_many_variable")
        .otherwise("ok")
    )
    found = found.withColumn("status", final)
    eid = F.when(F.col("status") == "ok", F.col("hit.eid")).when(F.col("status") == "match_failed", 0).otherwise(-1)
    values = F.when(F.col("status") == "ok", tk.variables(F.col("toks"), F.col("hit.tokens")))
    return found.withColumn("eid", eid.cast("int")).withColumn("vars", values).drop("hit", "fixed", "free", "anchor", "whole")


def masked_counts(parsed: DataFrame, least: int = 2) -> DataFrame:
    """(m, n, first): masked tokens seen `least` times or more, their records, and the first of these."""
    groups = parsed.where("status = 'ok'").select(tk.mask(F.col("toks")).alias("m"), "block_id", "rec_id")
    return groups.groupBy("m").agg(F.count("*").alias("n"), F.min(F.struct("block_id", "rec_id")).alias("first")).where(F.col("n") >= least)


def stored_templates(counted: DataFrame, config: LogConfig) -> DataFrame:
    """masked_counts -> (eid, ord, tokens, train_count): the templates of masked_templates that a model keeps, as a table.

    Only the places of the first records are ordered in one task, not the tokens.
    """
    by = W.orderBy("first", "h")
    short = F.size("m") < config.max_tokens
    named = counted.withColumn("h", F.xxhash64("m"))
    order = named.select("first", "h", short.alias("short")).select("first", "h", "short", F.row_number().over(by).alias("eid"), F.sum(F.col("short").cast("long")).over(by).alias("nth"))
    kept = order.where(F.col("short") & (F.col("nth") <= config.max_templates)).select("first", "h", "eid")
    return named.join(kept, ["first", "h"]).select("eid", F.col("eid").alias("ord"), F.col("m").alias("tokens"), F.col("n").alias("train_count"))


def masked_templates(parsed: DataFrame, least: int = 2) -> list[tuple[int, int, list[str], int]]:
    """Templates by grouping masked tokens: the order-free miner. Those seen less than `least` times are left out."""
    return listed(masked_counts(parsed, least))


def listed(counted: DataFrame) -> list[tuple[int, int, list[str], int]]:
    rows = counted.orderBy("first").collect()  # the model checks how many there are
    return [(i + 1, i + 1, list(r["m"]), r["n"]) for i, r in enumerate(rows)]


def usage(matched: DataFrame) -> DataFrame:
    return matched.where("eid > 0").groupBy("eid").agg(F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
