"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Documents fall into cells of source, language and topic; a cell's mass is its tokens. The cells' shares are raked: each
sweep scales them to the target marginals in turn, until all three hold. A cell's documents are then kept with the
probability that gives the cell its raked share of a token budget; probabilities stop at one, and the scale is raised so
that the budget still holds. A document is drawn by a hash of its id, so a lost executor draws the same ones again.

Targets are given as value -> share per marginal; without them a marginal is tempered: shares go as its tokens to a
power, which lifts small sources and languages. Topics come from a column, or are the first of a list of rules that a text meets.

The documents are read once for (cell, tokens) and pre-aggregated before the shuffle; raking touches cells only. Up to
`FEW_CELLS` cells are raked by windows, more by factors of the marginals' values that are joined and aggregated; both ways give
the same shares and the tests force either. If the targets contradict each other on the cells there are, the sweeps stop
at `SWEEPS`, a warning says so, and the last marginal raked holds.

Nulls: a null source or language is a value of its own, written as null; a null text has no tokens and the topic
`empty`. Repeated rows share one fate: rows of one id and cell are drawn or left together. Ties do not arise: a document is
compared with its own number only. An empty table gives no rows.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.llm.common import BROADCAST_ROWS, lookup_hot, materialize, unused

#: Sweeps at most, of which CHAIN are one job.
SWEEPS, CHAIN, CLOSE = 40, 5, 1e-6
#: Cells that one window may hold.
FEW_CELLS = 100_000
MARGINS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Share of all tokens that the mixture keeps.
BUDGET = 0.6
SEED = 7

#: The first rule that a text meets names its topic.
TOPICS = (
    ("empty", r"^\s*$"),
    ("legal", r"(?i)licen[sc]e|copyright|warranty"),
    ("table", r" \| "),
    ("contact", r"@|\+[0-9]"),
    ("figures", r"[0-9]{3}"),
)
OTHER = "prose"


def topic(text: Column, rules: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    out = F.when(text.isNull(), "empty")
    for name, rule in rules:
        out = out.when(text.rlike(rule), name)
    return out.otherwise(OTHER)


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _targets(cells: DataFrame, margin: str, given: dict[str, float] | None) -> DataFrame:
    """(value, t): shares that sum to one over the values that have tokens."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("mass").alias("m"))
    if given is None:
        goal = sums.select("value", F.pow(F.col("m"), POWERS[margin]).alias("t"))
    else:
        literal = reduce(lambda acc, kv: acc.when(F.col("value").eqNullSafe(kv[0]), kv[1]), given.items(), F.when(F.lit(False), 0.0))
        goal = sums.select("value", F.coalesce(literal, F.lit(0.0)).alias("t"))
    goal = materialize(goal, "targets")
    total = goal.agg(F.sum("t")).first()[0]
    return goal.withColumn("t", F.col("t") / F.lit(total)) if total else goal


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells (source, lang, topic, mass > 0) with their raked share in the column w."""
    mass, n = cells.agg(F.sum("mass"), F.count("*")).first()
    if not mass:
        return cells.withColumn("w", F.lit(0.0))
    goals = {m: _targets(cells, m, (targets or {}).get(m)) for m in MARGINS}
    found, off = (few_cells if n <= FEW_CELLS else many_cells)(cells, goals, mass)
    if off >= CLOSE:
        warnings.warn(f"raking stopped after {SWEEPS} sweeps, {off:.2g} off its targets", stacklevel=2)
    return found


def few_cells(cells: DataFrame, goals: dict[str, DataFrame], mass: float) -> tuple[DataFrame, float]:
    """(cells with w, how far off): at most FEW_CELLS, so that a marginal's window fits a task and several sweeps one job."""
    now = cells.withColumn("w", F.col("mass") / F.lit(mass))
    for m in MARGINS:
        goal = goals[m].select(F.col("value").alias("of"), F.col("t").alias(f"t_{m}"))
        now = now.join(F.broadcast(goal), F.col(m).eqNullSafe(F.col("of"))).drop("of")
    now, off = materialize(now, "cells"), 0.0
    for _ in range(SWEEPS // CHAIN):
        for _ in range(CHAIN):
            for m in MARGINS:
                whole = F.sum("w").over(W.partitionBy(m))
                now = now.withColumn("w", F.when(whole > 0, F.col("w") * F.col(f"t_{m}") / whole).otherwise(0.0))
        now = materialize(now, "cells")
        errors = now.select(*[F.abs(F.sum("w").over(W.partitionBy(m)) - F.col(f"t_{m}")).alias(m) for m in MARGINS]).agg(*[F.max(m) for m in MARGINS]).first()
        off = max(x or 0.0 for x in errors)
        if off < CLOSE:
            break
    return now.drop(*[f"t_{m}" for m in MARGINS]), off


def many_cells(cells: DataFrame, goals: dict[str, DataFrame], mass: float) -> tuple[DataFrame, float]:
    """The same for any number of cells: a cell's weight is its mass times a factor for each marginal value.

    A step aggregates the cells by one marginal, with the others' factors joined (by broadcast up to a checked number of values),
    and writes that marginal's factors alone.
    """
    small = {m: goals[m].count() <= BROADCAST_ROWS for m in MARGINS}
    factors = {m: goals[m].select("value", F.lit(1 / mass if m == MARGINS[0] else 1.0).alias("f")) for m in MARGINS}

    def weighted(margins: list[str], out: str) -> DataFrame:
        """cells with mass times the factors of these marginals."""
        found = cells.withColumn(out, F.col("mass"))
        for m in margins:
            table = factors[m].select(F.col("value").alias("of"), "f")
            found = found.join(F.broadcast(table) if small[m] else table, F.col(m).eqNullSafe(F.col("of"))).withColumn(out, F.col(out) * F.col("f")).drop("of", "f")
        return found

    off = 0.0
    for _ in range(SWEEPS):
        off = 0.0  # what each marginal is off by before it is raked again
        for m in MARGINS:
            sums = weighted([x for x in MARGINS if x != m], "part").groupBy(F.col(m).alias("value")).agg(F.sum("part").alias("s"))
            both = goals[m].alias("g").join(sums.alias("s"), F.col("g.value").eqNullSafe(F.col("s.value"))).join(factors[m].alias("o"), F.col("g.value").eqNullSafe(F.col("o.value")))
            new = both.select("g.value", F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(0.0).alias("f"), F.abs(F.col("o.f") * F.col("s") - F.col("t")).alias("off"))
            factors[m] = materialize(new, "factors")
            off = max(off, factors[m].agg(F.max("off")).first()[0] or 0.0)
        if off < CLOSE:
            break
    return weighted(list(MARGINS), "w"), off


def probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """cells with prob: least(1, scale * w / share of tokens), the scale such that the expected tokens meet the budget."""
    total = cells.agg(F.sum("mass")).first()[0]
    if not total:
        return cells.withColumn("prob", F.lit(1.0))
    share, scale = F.col("mass") / float(total), float(budget)
    for _ in range(64):  # each step clips more cells or is the last
        full = F.lit(scale) * F.col("w") >= share
        clipped, open_w = cells.agg(F.sum(F.when(full, share).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        new = (budget - clipped) / open_w if open_w > 0 and budget > clipped else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return cells.withColumn("prob", F.least(F.lit(1.0), F.lit(scale) * F.col("w") / share))


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """In [0, 1), the same for the same id."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / float(1 << 53)


def cell_of(docs: DataFrame, source: str, lang: str, text: str, topics: str | None) -> list[Column]:
    """The three marginals of each row; topics: a column that holds them, or None for the rules."""
    return [F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), (topic(F.col(text)) if topics is None else F.col(topics).cast("string")).alias("topic")]


def fit(docs: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float, doc_id: str, source: str, lang: str, text: str, topics: str | None) -> tuple[DataFrame, DataFrame, int]:
    """(rows, cells with prob and n, number of rows); rows: every row's id, cell and tokens, written once."""
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), *cell_of(docs, source, lang, text, topics), n_tokens(F.col(text)).alias("n_tokens")), "mix-rows")
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("mass"), F.count("*").alias("n"))
    cells = materialize(cells, "mix-cells")
    raked = materialize(rake(cells.where("mass > 0"), targets), "mix-raked")
    raked = materialize(probabilities(raked, budget).select(*MARGINS, "w", "prob", "n"), "mix-probabilities")
    rest = cells.where("mass <= 0").select(*MARGINS, F.lit(0.0).alias("w"), F.lit(1.0).alias("prob"), "n")  # no tokens, no weight: they cost nothing
    return rows, raked.unionByName(rest), rows.count()


def key(margins: list[Column] | None = None) -> Column:
    """A cell's name; nulls are told apart from texts."""
    return F.concat_ws("\x1f", *[F.concat(F.when(m.isNull(), "0").otherwise("1"), F.coalesce(m, F.lit(""))) for m in margins or map(F.col, MARGINS)])


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", topics: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, n_tokens, share (its cell's), prob, sampled."""
    rows, cells, total = fit(docs, targets, budget, doc_id, source, lang, text, topics)
    found = lookup_hot(rows.withColumn("cell", key()), cells.select(key().alias("cell"), F.col("w").alias("share"), "prob", "n"), "cell", "n", total)
    return found.select("doc_id", *MARGINS, "n_tokens", "share", "prob", (uniform(F.col("doc_id")) < F.col("prob")).alias("sampled"))


def sample_mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", topics: str | None = None) -> DataFrame:
    """The rows of docs that the mixture draws, with the same columns."""
    _, cells, total = fit(docs, targets, budget, doc_id, source, lang, text, topics)
    parts, cell, prob, n = unused(docs, "parts"), unused(docs, "cell"), unused(docs, "prob"), unused(docs, "n")
    own = docs.withColumn(parts, F.struct(*cell_of(docs, source, lang, text, topics))).withColumn(cell, key([F.col(parts)[m] for m in MARGINS]))
    found = lookup_hot(own, cells.select(key().alias(cell), F.col("prob").alias(prob), F.col("n").alias(n)), cell, n, total)
    return found.where(uniform(F.col(doc_id)) < F.col(prob)).select(*docs.columns)
