"""Personal data by weak supervision. DataFrame functions only.

Base spans (email, ip, card, phone) come from regular expressions with their checks. Further candidates (numbers with
the length of an identifier, names, handles) come from broad patterns. Labelers vote on every candidate, base or not: known formats,
a gazetteer of given names and one of words that are no names, cue words before and units after, and the shape of
digits. Expectation-maximisation over the counts of vote patterns estimates how far each labeler can be trusted; the
posteriors then are the soft labels of a final naive-Bayes classifier over features of the span. A candidate that it
puts over one half is a span as well; base spans stay whatever it says.

The texts are read twice and never shuffled: once to count patterns of votes and features, of which there are at most
`3 ** len(LABELERS)` times the feature values whatever the input (the driver gets these counts), and once to write the
result, with the classifier's weights as literals. Positions follow from the lengths of the matches and of the texts
between them. What stands before a match is looked at back to the match of the same kind before it.

Nulls: a null text counts as empty. Rows are independent: repeated rows repeat. An empty table gives no rows, and no
candidates train a classifier that adds nothing. A text costs time linear in its length, and its n matches n * sqrt(n) small
steps: an array that grows in a fold is copied at every step, so running sums are made in about sqrt(n) runs of sqrt(n). A text
and its spans must fit a row.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "number", "name", "handle")
BASE = KINDS[:4]
ROUNDS, SMOOTH = 40, 1.0

#: Each begins where a run begins and takes runs whole, which finds the leftmost matches without trying every start.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z.@/+-])\(?[0-9](?:[\x20()/.-]{0,2}[0-9])++",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?+|(?<![A-Za-z])[A-Z][a-z]++\x20[A-Z][a-z]++",
    "handle": r"(?<![A-Za-z0-9._%+@/-])@[A-Za-z0-9_]{3,30}+",
}
#: What a text must hold at all for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "number": None, "name": None, "handle": "@"}
OCTETS = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

# fixed values
FORMATS = r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{1,2}[/.][0-9]{1,2}[/.](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})$"
GIVEN = "anna|anne|carlos|charles|david|elena|elizabeth|emma|george|hans|ivan|james|jean|jennifer|john|jose|juan|julia|karen|laura|linda|lisa|louis|lucas|maria|marie|mark|mary|michael|paul|peter|pierre|richard|robert|sarah|sofia|susan|thomas|william"
NO_NAMES = "january|february|march|april|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday|public|license|general|university|street|united|states|new|north|south|east|west"
CUES = r"(?i)(?:phone|tel|mobile|call|fax|whatsapp|ssn|social security|passport|account|iban|born|birth|name|contact|customer|patient|e-?mail|address|signed|sincerely|regards)\W{0,4}(?:is|no|number|am)?\W{0,4}$"
AGAINST = r"(?i)(?:order|invoice|page|figure|table|section|version|chapter|price|total|isbn|issn|doi|line|build|port|[$€£#])\W{0,3}(?:no|number)?\W{0,3}$"
UNITS = r"(?i)^\W{0,2}(?:%|kg|km|mb|gb|ms|pages|items|rows|times|usd|eur|dollars|percent|years)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where the body names it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """array<int> of the joined values up to each place, join being associative."""

    def folded(part: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(join(F.element_at(acc, -1), x))))

        return F.aggregate(part, F.expr("cast(array() as array<int>)"), add)

    def placed(blocks: Column, tops: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda block, j: F.when(j == 0, block).otherwise(F.transform(block, lambda x: join(F.get(tops, j - 1), x)))))

    def made(v: Column) -> Column:
        return let(
            F.ceil(F.sqrt(F.size(v))).cast("int"),
            lambda width: let(
                F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda j: folded(F.slice(v, j * width + 1, width))),
                lambda blocks: let(folded(F.transform(blocks, lambda x: F.element_at(x, -1))), lambda tops: placed(blocks, tops)),
            ),
        )

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(made(v)))


SPAN = "struct<s:int,e:int,m:string,before:string,after:string>"


def spans(text: Column, pattern: str) -> Column:
    """All matches as (s, e, m, before, after): code points, end exclusive; up to 32 and 12 characters around them."""

    def found(rest: Column, matches: Column) -> Column:
        # match i stands between text i and text i + 1
        def placed(m: Column, i: Column, ends: Column) -> Column:
            e = F.get(ends, i)
            return F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"), F.right(F.get(rest, i), F.lit(32)).alias("before"), F.left(F.get(rest, i + 1), F.lit(12)).alias("after"))

        sums = running(F.transform(matches, lambda m, i: F.length(F.get(rest, i)) + F.length(m)), lambda a, b: a + b)
        return let(sums, lambda ends: F.transform(matches, lambda m, i: placed(m, i, ends)))

    return let(F.split(text, pattern, -1), lambda rest: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: found(rest, matches)))


def digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def luhn(m: Column) -> Column:
    """m with 13 to 19 digits."""

    def total(back: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = F.substring(back, i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add)

    return let(F.reverse(F.regexp_replace(m, "[^0-9]", "")), total) % 10 == 0


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(OCTETS),
    "card": lambda m: F.when(digits(m).between(13, 19), luhn(m)).otherwise(False),
    "phone": lambda m: digits(m).between(9, 15),
    "number": lambda m: digits(m).between(7, 19),
    "name": lambda m: F.lit(True),
    "handle": lambda m: F.lit(True),
}


def candidates(text: Column, kind: str) -> Column:
    """The spans of a kind that pass its check."""
    gate = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
    if kind in ("ip", "card", "phone", "number"):
        gate = gate & text.rlike("[0-9]")
    if kind == "name":
        gate = gate & text.rlike(r"[A-Z][a-z]*+\.?\x20[A-Z][a-z]")  # every match of the pattern holds this
    found = F.filter(spans(text, PATTERNS[kind]), lambda x: CHECKS[kind](x["m"]))
    return F.when(gate, found).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def with_kind(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), *[x[c].alias(c) for c in ("s", "e", "m", "before", "after")]))


def apart(found: Column, taken: Column) -> Column:
    """(s, e) of the spans in found that overlap none in taken, in order.

    Both are sorted together, and beside each stand the farthest end of taken spans so far and the nearest start of those to come.
    """
    both = F.concat(
        F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("own"), x["e"].alias("e"))),
        F.transform(taken, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("own"), x["e"].alias("e"))),
    )

    def clear(rows: Column, ends: Column, starts: Column) -> Column:
        free = F.filter(rows, lambda x, i: (x["own"] == 1) & (F.get(ends, i) <= x["s"]) & (F.get(starts, i) >= x["e"]))
        return F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    def walked(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: F.when(x["own"] == 0, x["e"]).otherwise(0)), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(rows, lambda x: F.when(x["own"] == 0, x["s"]).otherwise((1 << 31) - 1))), F.least))
        return let(ends, lambda e: let(starts, lambda s: clear(rows, e, s)))

    return F.when(F.size(taken) == 0, F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))).otherwise(let(F.array_sort(both), walked))


def vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def known_words(m: Column, words: str) -> Column:
    return m.rlike(rf"(?i)\b(?:{words})\b")


#: Each votes 1 (personal), -1 (not) or 0 on a candidate.
LABELERS: dict[str, Callable[[Column], Column]] = {
    "format": lambda x: vote(x["kind"].isin(*BASE) | x["m"].rlike(FORMATS), x["m"].rlike(r"^[0-9]+\.[0-9]{1,2}$")),
    "gazetteer": lambda x: vote((x["kind"] == "name") & known_words(x["m"], GIVEN), (x["kind"] == "name") & known_words(x["m"], NO_NAMES)),
    "cue": lambda x: vote(x["before"].rlike(CUES), x["before"].rlike(AGAINST)),
    "unit": lambda x: vote(F.lit(False), x["after"].rlike(UNITS)),
    "shape": lambda x: vote((x["kind"] != "name") & x["m"].rlike(r"[0-9][\x20()./-]+[0-9]"), (x["kind"] == "number") & ~x["m"].rlike("[^0-9]")),
    "title": lambda x: vote(x["m"].rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\b")),
}
#: Values 0, 1, ... of what the final classifier looks at.
FEATURES: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "kind": (len(KINDS), lambda x: (F.array_position(F.lit(list(KINDS)), x["kind"]) - 1).cast("int")),
    "length": (4, lambda x: F.least(F.lit(3), F.floor(F.length(x["m"]) / 8)).cast("int")),
    "cue": (3, lambda x: F.when(x["before"].rlike(CUES), 2).when(x["before"].rlike(AGAINST), 1).otherwise(0)),
    "form": (3, lambda x: F.when(x["m"].rlike(FORMATS), 2).when(x["m"].rlike(r"[A-Za-z@+()]|[0-9][\x20./-]+[0-9]"), 1).otherwise(0)),
}


def estimate(patterns: dict[tuple[int, ...], float]) -> tuple[float, list[dict[int, float]]]:
    """EM over counts of vote patterns -> (prior log odds, per labeler vote -> log odds); two classes, votes independent within one."""
    if not patterns:
        return 0.0, [dict.fromkeys((-1, 0, 1), 0.0) for _ in LABELERS]
    belief = {v: 1 / (1 + exp(-1.5 * sum(v))) for v in patterns}
    for _ in range(ROUNDS):
        yes = sum(n * belief[v] for v, n in patterns.items()) + SMOOTH
        no = sum(n * (1 - belief[v]) for v, n in patterns.items()) + SMOOTH
        prior, weights = log(yes / no), []
        for j in range(len(LABELERS)):
            table = {}
            for value in (-1, 0, 1):
                a = sum(n * belief[v] for v, n in patterns.items() if v[j] == value) + SMOOTH
                b = sum(n * (1 - belief[v]) for v, n in patterns.items() if v[j] == value) + SMOOTH
                table[value] = log(a / (yes + 2 * SMOOTH)) - log(b / (no + 2 * SMOOTH))
            weights.append(table)
        belief = {v: 1 / (1 + exp(-max(-30.0, min(30.0, prior + sum(w[x] for w, x in zip(weights, v, strict=True)))))) for v in patterns}
    return prior, weights


def train(counts: list[tuple[tuple[int, ...], tuple[int, ...], int]]) -> list[list[float]]:
    """(votes, features, rows) -> the classifier: the prior's log odds, then those of each feature's values."""
    patterns: dict[tuple[int, ...], float] = {}
    for votes, _, n in counts:
        patterns[votes] = patterns.get(votes, 0) + n
    prior, weights = estimate(patterns)
    sums = [[[SMOOTH, SMOOTH] for _ in range(size)] for size, _ in FEATURES.values()]
    total = [SMOOTH, SMOOTH]
    for votes, values, n in counts:
        p = 1 / (1 + exp(-max(-30.0, min(30.0, prior + sum(w[x] for w, x in zip(weights, votes, strict=True))))))
        total[0] += n * p
        total[1] += n * (1 - p)
        for table, value in zip(sums, values, strict=True):
            table[value][0] += n * p
            table[value][1] += n * (1 - p)
    return [[log(total[0] / total[1])]] + [[log(a / total[0]) - log(b / total[1]) for a, b in table] for table in sums]


def odds(x: Column, model: list[list[float]]) -> Column:
    total = F.lit(model[0][0])
    for (_, value), table in zip(FEATURES.values(), model[1:], strict=True):
        total = total + F.element_at(F.lit(table), value(x) + 1)
    return total


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    every = own.select("t", *[candidates(t, k).alias(k) for k in KINDS])
    every = every.select(F.explode(F.concat(*[with_kind(k, F.col(k)) for k in KINDS])).alias("x"))
    votes, values = [f(F.col("x")).alias(f"v_{k}") for k, f in LABELERS.items()], [f(F.col("x")).alias(f"f_{k}") for k, (_, f) in FEATURES.items()]
    counted = every.select(*votes, *values).groupBy(*[f"v_{k}" for k in LABELERS], *[f"f_{k}" for k in FEATURES]).count().collect()
    model = train(sorted((tuple(r[: len(LABELERS)]), tuple(r[len(LABELERS) : -1]), r[-1]) for r in counted))

    found = own.select("doc_id", *[candidates(t, k).alias(k) for k in KINDS])
    found = found.select("doc_id", *BASE, F.concat(*BASE).alias("taken"), *[F.filter(with_kind(k, F.col(k)), lambda x: odds(x, model) > 0).alias(k) for k in KINDS[len(BASE) :]])
    found = found.select("doc_id", *BASE, *[apart(F.col(k), F.col("taken")).alias(k) for k in KINDS[len(BASE) :]])  # what overlaps a base span is no span of its own

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    def listed(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.concat(*map(named, kinds)), ",")

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(BASE), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
