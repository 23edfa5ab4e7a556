"""Token expressions. One tokenizer serves mining and matching: runs of other characters, and each delimiter alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[^ \t:=,\n]+|[ \t:=,\n]"
WILD = "<*>"
NUMBER = r"^[0-9]+$"
ADDRESS = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


def tokens(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0))


def mask(toks: Column) -> Column:
    """Numbers and what starts like an address become wildcards."""
    return F.transform(toks, lambda t: F.when(t.rlike(NUMBER) | t.rlike(ADDRESS), WILD).otherwise(t))


def merge(a: Column, b: Column) -> Column:
    """Of equally long token arrays: a wildcard wherever they differ."""
    return F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(WILD))


def fits(toks: Column, template: Column) -> Column:
    """Whether every constant of a template of the same length is met."""
    return F.forall(F.zip_with(toks, template, lambda t, p: (p == WILD) | (t == p)), lambda ok: ok)


def variables(toks: Column, template: Column) -> Column:
    """The tokens where the template has wildcards."""
    kept = F.filter(F.arrays_zip(F.transform(toks, lambda t: t), F.transform(template, lambda p: p)), lambda x: x.getField("1") == WILD)
    return F.transform(kept, lambda x: x.getField("0"))


def rebuild(template: Column, values: Column) -> Column:
    """The text of a template with its wildcards filled in turn; the inverse of `variables`."""
    step = F.aggregate(
        template,
        F.struct(F.lit(0).alias("i"), F.lit("").alias("s")),
        lambda acc, p: F.when(p == WILD, F.struct((acc["i"] + 1).alias("i"), F.concat(acc["s"], F.element_at(values, acc["i"] + 1)).alias("s"))).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["s"], p).alias("s"))),
    )
    return step["s"]


def distance(template: Column, toks: Column) -> Column:
    """Equal non-delimiter constants over the total length; -1 where a delimiter of the template meets another token."""
    delimiter = r"^[ \t:=,\n]$"
    score = F.aggregate(
        F.zip_with(template, toks, lambda p, t: F.when(p.rlike(delimiter) & (p != t), -1).when(p.rlike(delimiter) | (p == WILD), 0).when(p == t, 1).otherwise(0)),
        F.lit(0),
        lambda acc, x: F.when((acc < 0) | (x < 0), -1).otherwise(acc + x),
    )
    return F.when(score < 0, -1.0).otherwise(score / F.size(toks))
