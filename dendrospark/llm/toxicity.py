"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, drops accents and invisible characters, maps homoglyphs of
other scripts to Latin letters and digits or signs used as letters back to them;
``i``, ``l`` and ``1`` share one class, since either letter is written as the digit.

The lexicon is learned: whole words and word beginnings of four to six letters
get the log-odds of being in a toxic text, counted by Spark over a bounded
sample of labelled rows (``SAMPLE`` rows, those with the smallest hashes). All
terms that qualify are kept; the sample bounds their number. Two thirds of the sample choose the lexicon, the rest fits the score's logistic curve
over the summed weights, plain and divided by the square root of the length.
Words inside an exception phrase don't count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, slices, written

SAMPLE = 16_000
LEAST = 4  # toxic texts that hold a term
ODDS = 2.5  # least log-odds of a term
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
# Phrases in which a term is harmless, folded like the texts.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clown car", "pond scum", "sore loser", "moron test", "not stupid", "not worthless", "not an idiot", "no idiot")

# Letters of other scripts and signs that look like Latin letters.
LOOKALIKES = {
    "a": "аαɑ@ａ", "b": "вƅЬ", "c": "сϲⅽ¢", "d": "ԁⅾ", "e": "еєε℮ҽ", "g": "ɡց", "h": "һհ", "i": "іıιɩ1!|lӏⅼⅰ", "j": "јϳ", "k": "кκ",
    "m": "мⅿ", "n": "ոπп", "o": "оοօσ0º", "p": "рρ", "q": "ԛգ", "r": "гг", "s": "ѕ$5", "t": "тτ7", "u": "υսц", "v": "νѵⅴ", "w": "ԝѡω", "x": "хχⅹ", "y": "уγү", "z": "ᴢ",
}
DIGITS = {"3": "e", "4": "a", "8": "b", "9": "g"}
INVISIBLE = "­​‌‍⁠﻿"


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(cp))[0].lower()
        if base != chr(cp) and base.isascii():
            out[cp] = base
    out |= {ord(ch): letter for letter, chars in LOOKALIKES.items() for ch in chars}
    out |= {ord(d): letter for d, letter in DIGITS.items()}
    out |= {ord(ch): "i" for ch in "IL"} | dict.fromkeys(map(ord, INVISIBLE))
    out |= {cp: "" for cp in range(0x300, 0x370)}
    return out


_FOLD = _table()
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def terms_of(word: str) -> list[str]:
    """A word's terms: itself with both ends marked, and its beginnings."""
    return [f" {word} ", *(f" {word[:k]}" for k in PREFIXES if len(word) > k)]


@dataclass
class Lexicon:
    """What scoring needs: the terms' weights and the curve. Terms come from a bounded sample, so it is small enough to broadcast."""

    weights: dict[str, float]
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0)
    exceptions: tuple[str, ...] = EXCEPTIONS
    auto: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"auto": None}

    def automaton(self):
        if self.auto is None:
            import ahocorasick

            auto = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                auto.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                folded = f" {fold(phrase)} "
                auto.add_word(folded, (len(folded), -1.0))
            auto.make_automaton()
            self.auto = auto
        return self.auto

    def hits(self, text: str) -> tuple[float, int, int]:
        """Summed weight, number of words that count, and number of words of a text."""
        words = WORD.findall(fold(text))
        if not self.weights and not self.exceptions:
            return 0.0, 0, len(words)
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for last, (size, weight) in self.automaton().iter(line):
            at = last - size + 1
            if weight < 0:
                spared.append((at, last))
            elif weight > best.get(at, 0.0):
                best[at] = weight
        if spared and best:
            starts, ends = np.array(spared).T  # by their ends, so the least start from each on gives the places that some phrase covers
            least = np.minimum.accumulate(starts[::-1])[::-1]
            for at in list(best):
                k = int(np.searchsorted(ends, at, "right"))
                if k < len(ends) and least[k] <= at:
                    del best[at]
        return sum(best.values()), len(best), len(words)

    def score(self, weight: float, n_words: int) -> float:
        b = self.curve
        x = b[0] + b[1] * math.log1p(weight) + b[2] * weight / math.sqrt(n_words + 1)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts and labels of at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic").where(~held_out() & F.col("toxic").isin(0, 1))
    # Bounded by the parameter: the smallest hashes, broadcast.
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample).dropDuplicates(["doc_id"])
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(text, '') text")
    return texts.join(F.broadcast(some), "doc_id").withColumn("fits", F.xxhash64("doc_id", F.lit(1)) % 3 == 0).select("doc_id", "text", "toxic", "fits")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon and curve from labelled rows. Without usable labels the lexicon is empty and every score is the same low value."""
    rows = written(training_rows(docs, labels, sample), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        size = 0
        for batch in slices(batches, 0):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = {t for w in set(WORD.findall(fold(text))) for t in terms_of(w)}
                seen[toxic].update(terms)
                size += len(terms)
            if size > 1_000_000:
                yield counted(*seen)
                seen, size = (Counter(), Counter()), 0
        yield counted(*seen)

    def counted(clean: Counter, toxic: Counter) -> pa.RecordBatch:
        terms = list(clean | toxic)
        return pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "clean": pa.array([clean[t] for t in terms], pa.int64()), "toxic": pa.array([toxic[t] for t in terms], pa.int64())})

    choose = rows.where("not fits")
    totals = choose.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    lexicon = Lexicon({}, exceptions=exceptions)
    if not n.get(0) or not n.get(1):
        return lexicon
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    counts = mapped(choose.select("text", "toxic"), count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    chosen = counts.where(F.col("toxic") >= LEAST).withColumn("odds", odds).where(F.col("odds") >= ODDS)
    lexicon.weights = {r["term"]: float(r["odds"]) for r in chosen.select("term", "odds").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            got = [shared.value.hits(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())], names=["toxic", "weight", "words"])

    got = mapped(rows.where("fits").select("text", "toxic"), features, "toxic int, weight double, words long").collect()  # at most SAMPLE rows of numbers
    lexicon.curve = fitted(np.array([[r[0], r[1], r[2]] for r in got], float).reshape(-1, 3))
    return lexicon


def fitted(rows: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps; slopes are kept at 0 or above, so more weight never lowers a score."""
    y, w, n = rows.T
    x = np.stack([np.ones_like(w), np.log1p(w), w / np.sqrt(n + 1)], 1)
    use = np.array([True, True, True])
    for _ in range(3):
        b = np.zeros(3)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
            grad = x.T @ (p - y) + ridge * b
            hess = (x.T * (p * (1 - p) + 1e-6)) @ x + ridge * np.eye(3)
            step = np.zeros(3)
            step[use] = np.linalg.solve(hess[np.ix_(use, use)], grad[use])
            b -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        if (b[1:] >= 0).all():
            break
        use[1:] &= b[1:] >= 0
    return tuple(map(float, b))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and toxic_terms (matches that count); all its columns and rows come back.

    A map over partitions. Null and empty texts get the score of no match; a
    repeated row is scored again; very long texts are scored whole; a table
    without rows gives none; a column named like a new one is replaced by it.
    """
    docs = docs.drop("toxicity", "toxic_terms")
    names, at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = docs.limit(0).withColumns({"toxicity": F.lit(0.0), "toxic_terms": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in slices(batches, at):
            got = [lex.hits(t or "") for t in batch.column(at).to_pylist()]
            new = [pa.array([lex.score(g[0], g[2]) for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "toxicity", "toxic_terms"])

    return mapped(docs, run, schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    lexicon = learn(docs, labels)
    scored = score(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), "toxic_terms")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns as they came."""
    own = {c: f"__own_{c}" for c in ("toxicity", "toxic_terms") if c in docs.columns}
    renamed = docs.withColumnsRenamed(own)
    kept = score(renamed, learn(docs, labels)).where(F.col("toxicity") < threshold).select(*renamed.columns)
    return kept.withColumnsRenamed({v: k for k, v in own.items()})
