"""Language identification: known words first, then ever shorter character n-grams.

The model has, per language, log frequencies of words and of character n-grams (with `^` and `$` at the word's ends). A
known word adds its log frequencies. An unseen word backs off: it is covered from the left by the longest n-grams that
the model knows (5 down to 1 characters), whose log frequencies are added; characters that no n-gram covers add nothing.
The score is the posterior of the best language, with the evidence per word tempered so that long texts stay gradual.

The model is fitted on a bounded sample of the labelled training rows: `SAMPLE` documents or a little more, drawn by a hash
of the id, so it behaves alike at every size. It holds every word of the sample and every n-gram of these words, so what is
broadcast is bounded by the sample. Every document is predicted from its whole text alone, runs of letters of any length whole.

Nulls: a null text, or one without a letter, is `und` with score 0. Letters that no language has get the
first language by name with an even score. Rows with a null text or language do not train. With
nothing to learn from (an empty table, no labels), every text is `und`. Repeated rows repeat.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import map_texts, unused

#: Labelled documents that the model is fitted on.
SAMPLE = 4_000
LONGEST = 5
#: Added to every count.
SMOOTH = 0.5
#: The evidence counts as if from so many words at most.
TEMPER = 12.0
#: Tokens that a worker remembers, of up to so many characters; the table starts anew when full.
MEMO, MEMO_LENGTH = 1 << 17, 64
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def count_grams(texts: DataFrame) -> DataFrame:
    """texts (lang, text) -> (lang, size, gram, n): words (size 0) and their n-grams; n-grams are cut from distinct words."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("gram")
    words = texts.select("lang", found).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    marked = F.concat(F.lit("^"), "gram", F.lit("$"))
    # a look-ahead takes the n characters behind each place
    sized = [F.struct(F.lit(k).alias("size"), F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)).alias("grams")) for k in range(1, LONGEST + 1)]
    grams = words.select("lang", "n", F.inline(F.array(*sized))).select("lang", "size", F.explode("grams").alias("gram"), "n")
    return words.select("lang", F.lit(0).alias("size"), "gram", "n").unionByName(grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))


class Model:
    """rows: gram -> log frequencies by language, as a row of one table; words and n-grams have dictionaries of their own."""

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        self.languages = sorted({lang for lang, *_ in counts})
        place = {lang: i for i, lang in enumerate(self.languages)}
        self.grams: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        tables = []
        for size, own in enumerate(self.grams):
            rows = [(own.setdefault(gram, len(own)), place[lang], n) for lang, s, gram, n in counts if s == size]
            table = np.full((len(own), max(1, len(self.languages))), SMOOTH)
            if rows:
                at, lang, n = (np.array(x) for x in zip(*rows, strict=True))
                np.add.at(table, (at, lang), n)
            total = table.sum(axis=0) - SMOOTH * len(own)
            table = np.log(table) - np.log(total + SMOOTH * (len(own) + 1))
            tables.append((table - table.max(axis=1, keepdims=True, initial=-np.inf)).astype(np.float32))  # only differences between languages matter
        self.tables = tables

    def row(self, size: int, gram: str) -> np.ndarray | None:
        at = self.grams[size].get(gram)
        return None if at is None else self.tables[size][at]

    def back_off(self, word: str) -> np.ndarray | None:
        word, at, total, used = f"^{word}$", 0, None, 0
        while at < len(word):
            for k in range(min(LONGEST, len(word) - at), 0, -1):
                if (row := self.row(k, word[at : at + k])) is not None:
                    total = row if total is None else total + row
                    used += 1
                    at += k
                    break
            else:
                at += 1
        return total / used if used else None

    def token(self, token: str) -> tuple[np.ndarray, int, int]:
        """What a run without white space adds, how many of its words the model knows something of, and its words."""
        total, seen, n = np.zeros(len(self.languages)), 0, 0
        for w in LETTERS.findall(token):
            n += any(map(str.isalpha, w))
            row = self.row(0, w)
            if row is None:
                row = self.back_off(w)
            if row is not None:
                total += row
                seen += 1
        return total, seen, n


class Scorer(dict):
    """token -> its row in a table that grows as tokens come, so that a text is scored by one gather and sum."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((MEMO + 1, len(model.languages) + 2), dtype=np.float32)

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        self.keep(n, token)
        return n

    def keep(self, n: int, token: str) -> None:
        total, seen, words = self.model.token(token)
        self.rows[n, :-2], self.rows[n, -2], self.rows[n, -1] = total, seen, words

    def sums(self, tokens: list[str]) -> np.ndarray:
        """The rows of at most half of what is remembered, added up."""
        long = [t for t in tokens if len(t) > MEMO_LENGTH]
        short = [t for t in tokens if len(t) <= MEMO_LENGTH] if long else tokens
        if len(self) + len(short) > MEMO:
            self.clear()
        total = self.rows[np.fromiter(map(self.__getitem__, short), dtype=np.int64, count=len(short))].sum(axis=0, dtype=np.float64)
        for t in long:  # the last row is for what is not remembered
            self.keep(MEMO, t)
            total += self.rows[MEMO]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages) + 2)
        tokens = text.lower().split()
        for a in range(0, len(tokens), MEMO // 2):
            total += self.sums(tokens[a : a + MEMO // 2])
        total, seen, words = total[:-2], total[-2], total[-1]
        if not words:
            return UNKNOWN, 0.0
        total *= min(1.0, TEMPER / max(seen, 1.0))
        odds = np.exp(total - total.max())
        best = int(odds.argmax())  # ties, and letters that no language has, go to the first language by name
        return self.model.languages[best], float(odds[best] / odds.sum())


def fit(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """The model of the rows where `training` holds; at most about `sample` of them, by a hash of the id."""
    labelled = docs.where(training & F.col(lang).isNotNull())
    n = labelled.count()  # reads no texts
    if n > sample:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    counts = count_grams(labelled.where(F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))).toArrow()  # bounded by the sample
    return Model(list(zip(*[counts.column(c).to_pylist() for c in ("lang", "size", "gram", "n")], strict=True)))


def predict_languages(docs: DataFrame, model: Model, keep: dict[str, str], text: str = "text") -> DataFrame:
    """keep beside lang_pred and score. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [scorer.predict(t) for t in texts]

    return map_texts(docs, text, keep, "lang_pred string, score double", make)


def keep_confident(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """docs without the rows whose language is unknown or told with a lower score, with the same columns. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [(lang != UNKNOWN and score >= least,) for lang, score in map(scorer.predict, texts)]

    kept = unused(docs, "kept")
    return map_texts(docs, text, {c: c for c in docs.columns}, f"`{kept}` boolean", make).where(F.col(kept)).select(*docs.columns)


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score. Learns from rows that are not held out."""
    model = fit(docs, ~held_out(F.col(doc_id)), doc_id, text, lang)
    out = predict_languages(docs, model, {"doc_id": doc_id}, text)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
