"""What training learns: header formats, templates, rules. Saved as Parquet tables that Spark reads anywhere."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.config import LogConfig
from timberline.operators.header import Slot
from timberline.operators.matching import described, template_table
from timberline.operators.rules import Candidate, Form


#: Tokens of all templates that the driver holds as a list, at most; a larger model stays a table.
DRIVER_TOKENS = 1 << 20


def is_large(templates: DataFrame, tokens: str = "tokens") -> bool:
    return (templates.agg(F.sum(F.size(tokens))).first()[0] or 0) > DRIVER_TOKENS


def usable(templates: list[tuple[int, int, list[str], int]], config: LogConfig) -> list[tuple[int, int, list[str], int]]:
    """The templates that a record can match, up to config.max_templates in their order; a warning tells how many go.

    Records of the others fail to match and are kept raw, so nothing is lost but size.
    """
    short = [t for t in templates if len(t[2]) < config.max_tokens]
    kept = sorted(short, key=lambda t: t[1])[: config.max_templates]
    if len(kept) < len(templates):
        warnings.warn(f"{len(templates) - len(short)} templates are too long and {len(short) - len(kept)} too many", stacklevel=2)
    return kept if len(kept) < len(templates) else templates


@dataclass
class Model:
    slots: list[Slot]
    templates: list[tuple[int, int, list[str], int]]
    #: eid -> (identifier positions, rules in order); positions are names of columns.
    rules: dict[int, tuple[list[str], list[tuple[str, Candidate]]]] = field(default_factory=dict)
    #: The templates (eid, ord, tokens, train_count) as a table, where they are too large for the driver; then `templates` is empty.
    stored: DataFrame | None = None

    def __post_init__(self):
        if len({t[0] for t in self.templates}) != len(self.templates) or any(t[0] < 1 for t in self.templates):
            raise ValueError("template ids must be positive and differ")

    def table(self, spark: SparkSession) -> DataFrame:
        return template_table(spark, self.templates) if self.stored is None else described(self.stored)

    def coder(self, templates: list[tuple[int, int, list[str], int]] | None = None) -> Model:
        """What a task needs that encodes, or decodes with these templates."""
        return Model(self.slots, templates or [], self.rules)

    def save(self, spark: SparkSession, path: str) -> None:
        templates = self.stored if self.stored is not None else spark.createDataFrame(self.templates, "eid int, ord int, tokens array<string>, train_count long").coalesce(1)
        templates.write.mode("overwrite").parquet(f"{path}/templates")
        slots = [(i, None if s.pieces is None else json.dumps(s.pieces)) for i, s in enumerate(self.slots)]
        spark.createDataFrame(slots, "slot int, pieces string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head_schema")
        rows = [
            (eid, step, json.dumps(ids), new, json.dumps([[f.base, f.kind, f.ident] for f in candidate]))
            for eid, (ids, rules) in self.rules.items()
            for step, (new, candidate) in enumerate(rules)
        ]
        spark.createDataFrame(rows, "eid int, step int, ids string, new string, forms string").coalesce(1).write.mode("overwrite").parquet(f"{path}/rules")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        stored = spark.read.parquet(f"{path}/templates")
        large = is_large(stored)
        templates = [] if large else [(r.eid, r.ord, list(r.tokens), r.train_count) for r in stored.orderBy("ord").collect()]
        slots = [Slot(None if r.pieces is None else tuple(json.loads(r.pieces))) for r in spark.read.parquet(f"{path}/head_schema").orderBy("slot").collect()]
        rules: dict = {}
        for r in spark.read.parquet(f"{path}/rules").orderBy("eid", "step").collect():
            rules.setdefault(r.eid, (json.loads(r.ids), []))[1].append((r.new, tuple(Form(*f) for f in json.loads(r.forms))))
        return cls(slots, templates, rules, stored if large else None)

    def metadata(self, spark: SparkSession) -> DataFrame:
        """(eid, text, train_count, json): each template as readable text and as JSON."""
        t = self.table(spark).select("eid", F.array_join("tokens", "").alias("text"), "train_count")
        return t.withColumn("json", F.to_json(F.struct("eid", "text", "train_count")))
