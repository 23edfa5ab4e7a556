"""Numeric rules: derived forms, differences of columns, their entropies, and the greedy choice of a cheap basis.

A form is a column as it is, or its backward or forward delta, plain or per identifier. A candidate is one form, a
difference of two or of three. Entropies are one aggregation over (candidate, value) counts; the driver gets a number a
candidate. For many candidates over many rows, Arrow batches are counted in sorted pieces first (`entropies_in_buckets`). Each chosen candidate adds one column that the ones before do not give, so that decoding solves in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW, DO, UP = "raw", "do", "up"
#: Rows counted at once; buckets of a candidate's values (a prime, as values may be multiples of powers of 2 or 10); values of a bucket counted in a table.
PIECE, BUCKETS, DENSE = 1 << 20, 61, 1 << 22


@dataclass(frozen=True, order=True)
class Form:
    base: str
    kind: str = RAW
    ident: str = ""

    @property
    def name(self) -> str:
        return "_".join(x for x in (self.base, self.kind if self.kind != RAW else "", self.ident) if x)


def all_forms(columns: Iterable[str], ids: Iterable[str] = ()) -> list[Form]:
    return [Form(c, k, i) for c in columns for k, i in [(RAW, ""), (UP, ""), (DO, ""), *[(k, i) for i in ids for k in (UP, DO)]]]


def pairs(forms: list[Form]) -> list[tuple[Form, Form]]:
    """Later minus earlier in the list, of different columns, with one identifier unless one side has none."""
    return [(b, a) for a, b in combinations(forms, 2) if a.base != b.base and (a.ident == b.ident or not a.ident or not b.ident)]


def triples(forms: list[Form]) -> list[tuple[Form, Form, Form]]:
    """c1 less c2 and c3 (c2 later than c3), all of different columns and of one identifier."""
    return [(c, b, a) for a, b in combinations(forms, 2) for c in forms if len({a.base, b.base, c.base}) == 3 and a.ident == b.ident == c.ident]


def catalog(forms: DataFrame) -> DataFrame:
    """Candidate pairs as a join of a form catalog (code, base, ident) with itself."""
    a, b = forms.alias("a"), forms.alias("b")
    near = (F.col("a.ident") == F.col("b.ident")) | (F.col("a.ident") == "") | (F.col("b.ident") == "")
    return a.join(b, (F.col("a.code") > F.col("b.code")) & (F.col("a.base") != F.col("b.base")) & near).select(F.col("a.code").alias("c1"), F.col("b.code").alias("c2"))


def catalog_triples(forms: DataFrame) -> DataFrame:
    a, b, c = forms.alias("a"), forms.alias("b"), forms.alias("c")
    two = b.join(c, (F.col("b.code") > F.col("c.code")) & (F.col("b.base") != F.col("c.base")) & (F.col("b.ident") == F.col("c.ident")))
    both = (F.col("a.ident") == F.col("b.ident")) & (F.col("a.base") != F.col("b.base")) & (F.col("a.base") != F.col("c.base"))
    return a.join(two, both).select(F.col("a.code").alias("c1"), F.col("b.code").alias("c2"), F.col("c.code").alias("c3"))


def entropy(n: Column, total: Column, of: Column) -> Column:
    """N ln N - sum(c ln c) from the counts c, as N times the entropy."""
    return F.round(total * F.ln(total) - F.sum(of * F.ln(of)), 4)


def entropies(rows: DataFrame, candidates: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """(keys, candidate, n, entropy): total entropy of each candidate's values, by one explode and two aggregations."""
    keys = keys or []
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), c.cast("bigint").alias("v")) for k, c in candidates.items()])).alias("x")
    counts = rows.select(*keys, each).groupBy(*keys, "x.candidate", "x.v").agg(F.count("*").alias("c"))
    summed = counts.groupBy(*keys, "candidate").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    return summed.select(*keys, "candidate", "n", F.round(F.col("n") * F.ln("n") - F.col("s"), 4).alias("entropy"))


def entropies_of(rows: DataFrame, values: Column, candidates: list[tuple[int, ...]]) -> DataFrame:
    """(candidate, n, entropy) for candidates given by places in the array `values`: the first less the others.

    The list is one constant, so the plan does not grow with the number of candidates.
    """
    known = F.from_json(F.lit(json.dumps([list(c) for c in candidates])), "array<array<int>>")
    less = lambda c, v, i: F.coalesce(F.get(v, F.get(c, F.lit(i))), F.lit(0))
    at = F.transform(F.array(values), lambda v: F.transform(known, lambda c: F.get(v, F.get(c, F.lit(0))) - less(c, v, 1) - less(c, v, 2)))
    counts = rows.select(F.posexplode(F.get(at, F.lit(0))).alias("candidate", "v")).groupBy("candidate", "v").agg(F.count("*").alias("c"))
    summed = counts.groupBy("candidate").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    return summed.select("candidate", "n", F.round(F.col("n") * F.ln("n") - F.col("s"), 4).alias("entropy"))


def bounds_of(form: Form, low: int, high: int) -> tuple[int, int]:
    """The least and greatest value that a form can have if its column lies between low and high."""
    return (low, high) if form.kind == RAW else (min(low, low - high), max(high, high - low))


def entropies_in_buckets(rows: DataFrame, columns: list[str], bounds: list[tuple[int, int]], candidates: list[tuple[int, ...]]) -> DataFrame:
    """(candidate, n, entropy) as `entropies` gives it, for integer columns whose values lie within bounds; a candidate is given by places in columns.

    A row is not multiplied by its candidates. Of each piece of rows, a candidate's values are sorted, dealt to buckets by their
    remainder and sent as quotients in as few bytes as bounds ask for, or as distinct ones with counts where that is less. A
    bucket of a candidate is counted in one task. Null is a value of its own.
    """
    spans = [(bounds[c[0]][0] - sum(bounds[x][1] for x in c[1:]), bounds[c[0]][1] - sum(bounds[x][0] for x in c[1:])) for c in candidates]
    if any(low < -(1 << 62) or high >= 1 << 62 or high - low >= 1 << 61 for low, high in [*spans, *bounds]):
        each = {str(k): reduce(sub, [F.col(columns[x]).cast("bigint") for x in c]) for k, c in enumerate(candidates)}
        return entropies(rows, each).select(F.col("candidate").cast("int"), "n", "entropy")
    quotients = [(high - low) // BUCKETS + 1 for low, high in spans]
    kinds = [np.min_scalar_type(q) for q in quotients]
    sent = pa.schema([("candidate", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("held", pa.binary()), ("times", pa.binary())])

    def pieces(values: list[np.ndarray], known: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
        for k, c in enumerate(candidates):
            v, valid = values[c[0]] - spans[k][0], None
            for x in c[1:]:
                v = v - values[x]
            for x in c:
                if known[x] is not None:
                    valid = known[x] if valid is None else valid & known[x]
            made = []
            if valid is not None:
                made += [(k, -1, int((~valid).sum()), b"", None)] if not valid.all() else []
                v = v[valid]
            q = v // BUCKETS
            v = (v - q * BUCKETS) * quotients[k] + q
            v = np.sort(v.astype(np.int32) if quotients[k] * BUCKETS < 1 << 31 else v)
            starts = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
            times = None
            if 3 * len(starts) < len(v):
                times = np.diff(starts, append=len(v)).astype(np.uint32)
                v = v[starts]
            cuts = np.searchsorted(v, np.arange(BUCKETS + 1) * quotients[k])
            for b in range(BUCKETS):
                i, j = cuts[b], cuts[b + 1]
                if i < j:
                    made.append((k, b, int(j - i if times is None else times[i:j].sum()), (v[i:j] - b * quotients[k]).astype(kinds[k]).tobytes(), None if times is None else times[i:j].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), sent, strict=True)], schema=sent) if made else pa.RecordBatch.from_pylist([], sent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            known = [c.is_valid().to_numpy() if c.null_count else None for c in table.columns]
            yield from pieces([pc.fill_null(c, bounds[i][0]).to_numpy() for i, c in enumerate(table.columns)], known)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PIECE:
                yield from whole()
        if held:
            yield from whole()

    def merge(group: pa.Table) -> pa.Table:
        k, b = group.column("candidate")[0].as_py(), group.column("bucket")[0].as_py()
        total = sum(group.column("n").to_pylist())
        counts = np.array([total])
        if b >= 0:
            held = [np.frombuffer(x, dtype=kinds[k]) for x in group.column("held").to_pylist()]
            times = [None if x is None else np.frombuffer(x, dtype=np.uint32) for x in group.column("times").to_pylist()]
            counts = _counts(held, times, quotients[k])
        return pa.table({"candidate": [k], "n": [total], "s": [float((counts * np.log(counts)).sum())]}, pa.schema([("candidate", pa.int32()), ("n", pa.int64()), ("s", pa.float64())]))

    parts = rows.select(*[F.col(c).cast("bigint") for c in columns]).mapInArrow(count, "candidate int, bucket int, n long, held binary, times binary")
    summed = parts.groupBy("candidate", "bucket").applyInArrow(merge, "candidate int, n long, s double").groupBy("candidate").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return summed.select("candidate", "n", F.round(F.col("n") * F.ln("n") - F.col("s"), 4).alias("entropy"))


def _counts(held: list[np.ndarray], times: list[np.ndarray | None], most: int) -> np.ndarray:
    """How often each value below most occurs in pieces of sorted values, each with its count (times) or repeated."""
    if most <= DENSE:
        out = np.zeros(most, dtype=np.int64)
        for v, t in zip(held, times, strict=True):
            if t is None:
                some = np.bincount(v.astype(np.int64))
                out[: len(some)] += some
            else:
                out[v] += t  # distinct ones
        return out[out > 0]
    v = np.concatenate(held)
    t = np.concatenate([np.ones(len(x), dtype=np.int64) if y is None else y.astype(np.int64) for x, y in zip(held, times, strict=True)])
    order = np.argsort(v, kind="stable")
    v, t = v[order], t[order]
    return np.add.reduceat(t, np.flatnonzero(np.append(True, v[1:] != v[:-1])))


Candidate = tuple[Form, ...]


def greedy(columns: list[str], scores: dict[Candidate, float]) -> list[tuple[str, Candidate]]:
    """(new column, candidate) in the order of choice; every column is introduced once. Ties: fewer forms, then names.

    Each step takes the cheapest candidate all of whose columns but one were chosen before: at first a single form, then
    also pairs with a chosen column and triples with two.
    """
    chosen: list[str] = []
    out: list[tuple[str, Candidate]] = []
    key = lambda c: (scores[c], len(c), c)
    while len(chosen) < len(columns):
        fit = [c for c in scores if sum(f.base not in chosen for f in c) == 1]
        best = min(fit, key=key)
        new = next(f.base for f in best if f.base not in chosen)
        chosen.append(new)
        out.append((new, best))
    return out


# forms over arrays, for encoding one template's rows of a block


def _by_id(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows ordered by id, whether each is the first and the last of its id)."""
    order = np.argsort(ids, kind="stable")
    first = np.ones(len(ids), dtype=bool)
    first[1:] = ids[order[1:]] != ids[order[:-1]]
    return order, first, np.append(first[1:], True)


def derive(v: np.ndarray, form: Form, ids: dict[str, np.ndarray]) -> np.ndarray:
    if form.kind == RAW or not len(v):
        return v
    order, first, last = _by_id(ids[form.ident]) if form.ident else (np.arange(len(v)), np.arange(len(v)) == 0, np.arange(len(v)) == len(v) - 1)
    s, out = v[order], np.empty_like(v)
    step = np.diff(s)
    out[order] = np.where(first, s, np.concatenate([[0], step])) if form.kind == DO else np.where(last, s, np.concatenate([step, [0]]))
    return out


def underive(d: np.ndarray, form: Form, ids: dict[str, np.ndarray]) -> np.ndarray:
    if form.kind == RAW or not len(d):
        return d
    order, first, last = _by_id(ids[form.ident]) if form.ident else (np.arange(len(d)), np.arange(len(d)) == 0, np.arange(len(d)) == len(d) - 1)
    s, out = d[order], np.empty_like(d)
    if form.kind == DO:
        sums = np.cumsum(s)
        starts = np.flatnonzero(first)
        base = np.concatenate([[0], sums])[starts]
        out[order] = sums - np.repeat(base, np.diff(np.append(starts, len(s))))
        return out
    # v_i = v_last - sum of u_i .. before the last, and u_last = v_last
    ends = np.flatnonzero(last)
    tail = np.repeat(np.cumsum(s)[ends], np.diff(np.concatenate([[-1], ends])))
    rest = tail - np.cumsum(s) + s  # from here to the end of the id
    out[order] = 2 * np.repeat(s[ends], np.diff(np.concatenate([[-1], ends]))) - rest
    return out


def apply_rules(values: dict[str, np.ndarray], rules: list[tuple[str, Candidate]], ids: dict[str, np.ndarray]) -> list[np.ndarray]:
    out = []
    for _, candidate in rules:
        parts = [derive(values[f.base], f, ids) for f in candidate]
        out.append(parts[0] - sum(parts[1:], np.zeros_like(parts[0])))
    return out


def solve_rules(streams: list[np.ndarray], rules: list[tuple[str, Candidate]], ids: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The columns from the streams: each step solves for the form of the column that it introduced."""
    values: dict[str, np.ndarray] = {}
    for stream, (new, candidate) in zip(streams, rules, strict=True):
        at = next(i for i, f in enumerate(candidate) if f.base == new)
        others = [derive(values[f.base], f, ids) if i != at else None for i, f in enumerate(candidate)]
        if at == 0:
            form = stream + sum((o for o in others[1:]), np.zeros_like(stream))
        else:
            form = others[0] - stream - sum((o for i, o in enumerate(others) if i not in (0, at)), np.zeros_like(stream))
        values[new] = underive(form, candidate[at], ids)
    return values
