from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, w string, hits string, shard string, topic string, fp string, score string, h string, pos long"


def rows_of():
    """Documents with nulls, empty and very long texts, ties, repeated rows; the columns after n_chars clash with inner names."""
    r = random.Random(5)
    vocabulary = ["the", "of", "and", "Straße", "naïve", "日本", "tokens", "x1", "seven", "mountain", "river", "été", "Blue", "GREEN", "a"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = prose(150)
    texts = [None, "", " ", "\n\t", "a", "a b", "!!! 123 ???", base, base, base.upper(), base + " tail", "head " + base, base[:200], base[100:400], prose(40), "é" * 30, "ab" * 60, "ab" * 61]
    texts += [prose(30) + " " + base[300:420] + " " + prose(20) for _ in range(4)]
    texts += ["long " + prose(40_000), "z" * 5_000, " ".join(["same"] * 3_000)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[0], (None, base, "en", "s1", 5), (None, "only here without an id", "en", None, 5), (None, None, None, None, None), (-5, prose(60), "en", "s1", 5)]
    return [(*x, 1, "w", "h", "s", "t", "f", "s", "h", 1) for x in rows]


@pytest.fixture(scope="session")
def edges(spark):
    rows = rows_of()
    return spark.createDataFrame(rows, SCHEMA), [(x[0], x[1]) for x in rows]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    """The smallest documents table and its (doc_id, text) rows."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, [tuple(x) for x in df.select("doc_id", "text").collect()]
