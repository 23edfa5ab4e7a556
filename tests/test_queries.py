"""Every query of the engine against its SQL; those without SQL must give rows."""

from __future__ import annotations

import helpers
import pytest

from timberline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE_SQL:
        assert helpers.differ(df, con, catalog.ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_identifiers_and_limits_are_met(spark, sf):
    """The rows that these queries are for are there."""
    assert catalog.QUERIES["order_identifiers"](spark, sf).count() >= 1
    assert {r["status"] for r in catalog.QUERIES["load_failures"](spark, sf).select("status").distinct().collect()} >= {"ok", "load_failed:bad_char", "load_failed:too_long", "load_failed:empty"}


def test_tree_miner_templates_against_the_plain_fold(spark, sf, con):
    import re

    from test_operators import fold

    from timberline.operators import tokens as tk

    lines = [r[0] for r in con.execute(f"SELECT line FROM ({catalog.views.EVENT_LOG}) x ORDER BY line_no").fetchall()]
    contents = [re.sub(r"^[ \t|]*(?:[^ \t|\n]+[ \t|]*){3}", "", x) for x in lines]
    masked = [["<*>" if re.fullmatch(r"[0-9]+", t) or re.match(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", t) else t for t in re.findall(tk.TOKEN, x)] for x in contents]
    found = catalog.QUERIES["tree_miner_templates"](spark, sf).orderBy("eid").collect()
    assert [(r["text"], r["train_count"]) for r in found] == [("".join(t), n) for t, n in fold(masked, catalog.EVENTS.similarity)]


def test_greedy_rules_against_plain_entropies(spark, sf, con):
    from collections import Counter
    from itertools import combinations
    from math import log

    names = catalog.VALUES
    rows = con.execute(f"SELECT block_id, {', '.join(names)} FROM ({catalog.views.ITEM_VALUES}) x ORDER BY block_id, {catalog.SORT}").fetchall()
    blocks = {}
    for b, *v in rows:
        blocks.setdefault(b, []).append(v)
    forms = []  # (base, name, values), as the engine lists them
    for i, c in enumerate(names):
        own = [[v[i] for v in block] for block in blocks.values()]
        forms.append((c, c, [x for b in own for x in b]))
        forms.append((c, f"{c}_up", [x for b in own for x in [*(q - p for p, q in zip(b, b[1:], strict=False)), b[-1]]]))
        forms.append((c, f"{c}_do", [x for b in own for x in [b[0], *(q - p for p, q in zip(b, b[1:], strict=False))]]))

    def entropy(values):
        n = Counter(values)
        return round(len(values) * log(len(values)) - sum(x * log(x) for x in n.values()), 4)

    order = lambda parts: tuple((f[0], f[1][len(f[0]) + 1 :] or "raw", "") for f in parts)
    scored = [((f,), entropy(f[2])) for f in forms] + [((b, a), entropy([y - x for x, y in zip(a[2], b[2], strict=True)])) for a, b in combinations(forms, 2) if a[0] != b[0]]
    chosen, expected = set(), []
    while len(chosen) < len(names):
        fit = [(s, len(c), order(c), c) for c, s in scored if len({f[0] for f in c} - chosen) == 1]
        best = min(fit, key=lambda x: x[:3])[3]
        new = next(f[0] for f in best if f[0] not in chosen)
        chosen.add(new)
        expected.append((len(expected), new, "-".join(f[1] for f in best)))
    assert [tuple(r) for r in catalog.QUERIES["greedy_rules"](spark, sf).orderBy("step").collect()] == expected


def test_compression_ratio_counts_what_is_there(spark, sf, con):
    n, size = con.execute(f"SELECT count(*), sum(length(line) + 1) FROM ({catalog.views.EVENT_LOG}) x").fetchone()
    found = {r["metric"]: r["value"] for r in catalog.QUERIES["compression_ratio"](spark, sf).collect()}
    assert found["raw_bytes"] == size and sum(v for k, v in found.items() if not k.endswith("_bytes")) == n
    assert 0 < found["encoded_bytes"] < size / 3


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_match_is_a_broadcast_join_on_the_length(spark, sf):
    plan = catalog.QUERIES["template_match"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [n_tokens" in plan


def test_scan_reads_only_what_it_needs(spark, sf):
    plan = catalog.QUERIES["entropy_single"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_comment" not in plan


def test_roundtrip_multi_trains_on_all_documents(spark, sf, monkeypatch):
    class Seen(Exception):
        pass

    def train(lines, *_, **__):
        raise Seen(lines.select("block_id").distinct().count(), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").distinct().count())

    monkeypatch.setattr(catalog.pipeline, "train", train)
    with pytest.raises(Seen) as seen:
        catalog.roundtrip_multi(spark, sf)
    assert seen.value.args[0] > 100 and seen.value.args[1] > 100
