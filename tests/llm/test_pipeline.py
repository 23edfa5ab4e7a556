"""The pipeline's stages against plain versions of their operators."""

from __future__ import annotations

import brute

import corpus_pipeline
from timberline.llm import mixing
from timberline.llm.common import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = materialize(stage(spark, docs, sf), "test")
        after = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        ids = {r["doc_id"] for r in after}
        if name == "language_id":
            training = [(r["lang"], r["text"]) for r in before if r["lang"] is not None and r["text"] is not None and brute.crc(str(r["doc_id"])) % 3 != 1]
            scored = zip(before, brute.languages(training, [r["text"] for r in before]), strict=True)
            sure = {r["doc_id"]: lang != "und" and score >= corpus_pipeline.LEAST_SCORE for r, (lang, score) in scored if abs(score - corpus_pipeline.LEAST_SCORE) > 1e-3}
            assert all((d in ids) == stays for d, stays in sure.items()) and len(sure) > 0.98 * len(before)
        elif name == "near_dedup":
            assert ids == one_of_each({r["doc_id"]: r["text"] for r in before})
        elif name == "decontamination":
            found = brute.contamination([(r["doc_id"], r["text"]) for r in before], bench)
            assert ids == {f[0] for f in found if not f[-1]}
        elif name == "mixing":
            expected = brute.mixture([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before], mixing, mixing.BUDGET)
            assert {x[0] for x in expected if x[7] < x[6] - 1e-3} <= ids <= {x[0] for x in expected if x[7] < x[6] + 1e-3}
        else:
            assert [r["doc_id"] for r in after] and ids == {r["doc_id"] for r in before}
            sizes, homes = {}, {}
            for r in after:
                sizes[r["shard"]] = sizes.get(r["shard"], 0) + brute.size(r["text"])
                homes.setdefault(r["text"], set()).add(r["shard"])
            assert set(sizes) <= set(range(40)) and all(len(h) == 1 for h in homes.values())
            assert max(sizes.values()) == brute.least_capacity(brute.group_sizes([r["text"] for r in before]), 40)


def one_of_each(texts):
    """The smallest id of each group of texts that are alike through others, by all pairs."""
    ids = sorted(texts)
    sets = {d: brute.shingles(t) for d, t in texts.items()}
    parent = dict(zip(ids, ids, strict=True))

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and brute.jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {find(d) for d in ids}


def test_edges_and_nothing(spark, edges, none, sf):
    for name, stage in corpus_pipeline.STAGES:
        for df in (edges[0], none):
            out = stage(spark, df, sf)
            assert out.count() <= df.count()
            assert set(df.columns) <= set(out.columns), name


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "shard" in out.columns
