"""Similarity mining of templates: an ordered fold over a sample through a prefix tree.

Records of different token counts never meet in the tree, so each count is folded by a task of its own in record order,
which gives just what one fold over all would. A fold in order cannot be split, so a task holds all records of its count:
`train` folds a sample of bounded size unless it is told to fold everything.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.config import LogConfig
from timberline.operators import tokens as tk

DELIMITER = re.compile(r"[ \t:=,\n]")
DIGIT = re.compile(r"[0-9]")


class Cluster:
    def __init__(self, toks: list[str], first: tuple[int, int]):
        self.tokens, self.first, self.count = list(toks), first, 1

    def likeness(self, toks: list[str]) -> tuple[float, int]:
        """(equal words over all tokens, wildcards); -1 if a delimiter of the template meets something else."""
        same = wild = 0
        for mine, other in zip(self.tokens, toks, strict=True):
            if DELIMITER.fullmatch(mine):
                if mine != other:
                    return -1.0, 0
            elif mine == tk.WILD:
                wild += 1
            elif mine == other:
                same += 1
        return same / len(toks), wild

    def absorb(self, toks: list[str]) -> None:
        self.tokens = [a if a == b else tk.WILD for a, b in zip(self.tokens, toks, strict=True)]
        self.count += 1


class PrefixTree:
    """Children by token on the first levels, but never on a record's last token; wildcards beside; clusters at the leaves."""

    def __init__(self, config: LogConfig):
        self.levels, self.most, self.least, self.root = config.depth - 1, config.max_children, config.similarity, {}
        self.clusters: list[Cluster] = []

    def path(self, toks: list[str]) -> list[str]:
        return toks[: max(0, min(self.levels, len(toks) - 1))]

    def find(self, toks: list[str]) -> Cluster | None:
        node = self.root
        for t in self.path(toks):
            node = node.get(t) or node.get(tk.WILD)
            if node is None:
                return None
        scored = [(*c.likeness(toks), -i, c) for i, c in enumerate(node.get("", []))]
        best = max(scored, key=lambda s: s[:3], default=None)
        return best[3] if best and best[0] >= self.least else None

    def insert(self, cluster: Cluster) -> None:
        node = self.root
        for t in self.path(cluster.tokens):
            if t not in node and (DIGIT.search(t) or len(node) + 1 >= self.most):
                t = tk.WILD
            node = node.setdefault(t, {})
        node.setdefault("", []).append(cluster)
        self.clusters.append(cluster)

    def add(self, toks: list[str], at: tuple[int, int]) -> None:
        found = self.find(toks) if toks else None
        if found:
            found.absorb(toks)
        else:
            self.insert(Cluster(toks, at))


def tree_templates(parsed: DataFrame, config: LogConfig, least: int = 2) -> list[tuple[int, int, list[str], int]]:
    """(eid, ord, tokens, count) in the order of first appearance; clusters seen less than `least` times are left out."""
    masked = parsed.where("status = 'ok'").select(F.size("toks").alias("n_tokens"), "block_id", "rec_id", tk.mask(F.col("toks")).alias("m"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        tree = PrefixTree(config)
        for r in group.sort_values(["block_id", "rec_id"]).itertuples(index=False):
            tree.add(list(r.m), (int(r.block_id), int(r.rec_id)))
        return pd.DataFrame([(*c.first, c.tokens, c.count) for c in tree.clusters if c.count >= least], columns=["block_id", "rec_id", "tokens", "n"])

    found = masked.groupBy("n_tokens").applyInPandas(fold, "block_id long, rec_id long, tokens array<string>, n long")
    rows = found.orderBy("block_id", "rec_id").collect()
    return [(i + 1, i + 1, list(r["tokens"]), r["n"]) for i, r in enumerate(rows)]
