"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Texts are lower-cased, homoglyphs become Latin letters, digits that stand for letters become those letters, and everything
else in ASCII becomes a blank. The lexicon (whole words and beginnings of words) and its weights, smoothed log odds, are
learned from a bounded sample of labelled rows that aren't held out; so are the exception phrases, pairs of neighbouring words
that hold a term and yet are no more frequent in toxic rows, and the logistic curve from the length-normalised sum of weights
to a score. Matches inside an exception phrase don't count. The lexicon keeps its ``MAX_TERMS`` heaviest terms.

Labels: a doc_id is toxic if any of its labels is above 0 or true; null labels are ignored, and so are labels of a null doc_id;
of a doc_id's several texts the smallest is learned from. A null doc_id is never held out. Null and empty texts score as a text without a
match. Without any labelled row, or with labels of one kind only, every text gets the share of toxic labels (0 if none), and
nothing is matched. Very long texts are matched whole; repeated rows are scored each; extra columns are ignored. An empty table
gives an empty result. Of terms that tie at the limit the first in the alphabet stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, with_text, written

#: Labelled rows to learn from, about: three quarters give the lexicon, the rest the curve.
TRAIN_ROWS = 12_000
#: A term must be in so many toxic rows, with this log odds and this many of its standard errors, and at most so many are kept.
MIN_POSITIVE, MIN_WEIGHT, MIN_Z, MAX_TERMS = 3, 1.5, 3.5, 5000
#: Beginnings of words that are looked at besides whole words, in characters.
PREFIXES = (6, 8)
#: An exception phrase must be in so many rows that aren't toxic, and at most so many are kept.
MIN_HARMLESS, MAX_PHRASES = 5, 1000
#: Phrases, folded, in which a term is harmless, besides those that are learned.
EXCEPTIONS = ("idiot proof", "clown fish", "trash can", "trash bin", "sore loser", "pond scum")
#: Characters that look like a Latin letter: Cyrillic and Greek, then the letters that they look like.
LOOKALIKES = str.maketrans("аеіјорсухѕԁԛԝһαεικνορτυχ", "aeijopcyxsdqwhaeiknoptux")
#: Digits written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_LOOKS = re.compile(f"[{''.join(map(chr, LOOKALIKES))}]|[！-～]")
_WIDE = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)}
_ASCII = bytes(ord(DIGITS[chr(i)]) if chr(i) in DIGITS else i if i > 127 or chr(i).isalpha() else 32 for i in range(256))


def fold(text: str) -> str:
    """Lower case, letters folded, a blank at either end and for every other ASCII character."""
    text = text.lower()
    if not text.isascii() and _LOOKS.search(text):
        text = text.translate(_WIDE).translate(LOOKALIKES).lower()
    return f" {text.encode().translate(_ASCII).decode()} "


class Lexicon:
    """Terms with weights and exception phrases in one automaton. A term begins with a blank; a whole word ends with one."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, curve: tuple[float, float] = (0.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for term, w in self.weights.items():
                found.add_word(term, (len(term), w))
            for phrase in self.exceptions if self.weights else ():
                found.add_word(f" {phrase} ", (len(phrase) + 2, None))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def total(self, folded: str) -> float:
        """Sum over matched words of the largest weight of a term there."""
        automaton = self.automaton()
        if not len(automaton):
            return 0.0
        best: dict[int, float] = {}
        harmless = []
        for end, (size, w) in automaton.iter(folded):
            at = end - size + 1
            if w is None:
                harmless.append((at, end))
            elif w > best.get(at, 0.0):
                best[at] = w
        for a, b in harmless:
            best = {at: w for at, w in best.items() if not a <= at < b}
        return sum(best.values())

    def pairs(self, folded: str) -> set[str]:
        """Pairs of neighbouring words of which one begins as a term does."""
        automaton, out = self.automaton(), set()
        for end, (size, w) in automaton.iter(folded) if len(automaton) else ():
            at = end - size + 1  # the blank before the word
            if w is None:
                continue
            stop = folded.find(" ", at + 1)
            after, before = folded[stop + 1 :].split(" ", 1)[0] if stop >= 0 else "", folded[:at].rsplit(" ", 1)[-1]
            word = folded[at + 1 : stop]
            out |= {f"{word} {after}"} if after else set()
            out |= {f"{before} {word}"} if before else set()
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        """Sum of weights over the logarithm of the length, for each text."""
        out = np.empty(len(texts))
        for i, text in enumerate(pc.fill_null(texts, "")):
            text = fold(text.as_py())
            out[i] = self.total(text) / np.log2(2 + len(text) / 500)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * self.features(texts), -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of one feature by Newton's method, lightly penalised."""
    design = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - np.array([0, 0.1]) * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.1])
        beta += np.linalg.solve(hessian, gradient)
    return float(beta[0]), float(max(0.0, beta[1]))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic").cast("double") > 0).cast("int")).alias("toxic"))
    n = marked.count()
    parts = 1_000_000
    share = int(parts * min(1.0, train_rows / max(1, n)))
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)
    # about train_rows narrow rows at most, one for each doc_id, whatever the input: they can be broadcast
    met = with_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = written(met.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))))
    sizes = {(r["toxic"], r["part"] == 0): r["n"] for r in sample.groupBy("toxic", (F.col("part") == 0).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, negatives = (sum(v for (t, _), v in sizes.items() if t == k) for k in (1, 0))
    if not positives or not negatives:
        return Lexicon({}, (), (30.0 if positives else -30.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = set(fold(text or "").split())
                seen[toxic].update({f" {w} " for w in found if len(w) > 2}.union(f" {w[:k]}" for w in found for k in PREFIXES if len(w) > k))
        terms = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(terms), 50_000):
            some = terms[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([seen[1][t] for t in some], pa.int64()), pa.array([seen[0][t] for t in some], pa.int64())], names=["term", "p", "n"])

    p_all, n_all = sizes.get((1, False), 0), sizes.get((0, False), 0)
    p, q = F.col("p") + 0.5, F.col("n") + 0.5
    weight = F.log(p / (p_all + 1)) - F.log(q / (n_all + 1))
    terms = (
        sample.filter("part <> 0").mapInArrow(count, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        .filter((F.col("p") >= MIN_POSITIVE) & (weight >= MIN_WEIGHT) & (weight >= MIN_Z * F.sqrt(1 / p + 1 / q)))
        .select("term", weight.alias("w")).orderBy(F.desc("w"), "term").limit(MAX_TERMS)
    )
    lexicon = Lexicon({r["term"]: r["w"] for r in terms.collect()})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(lexicon.pairs(fold(text or "")))
        found = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([seen[1][t] for t in found], pa.int64()), pa.array([seen[0][t] for t in found], pa.int64())], names=["term", "p", "n"])

    harmless = (
        sample.filter("part <> 0").mapInArrow(pairs, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        .filter((F.col("n") >= MIN_HARMLESS) & (weight <= 0)).orderBy(F.desc("n"), "term").limit(MAX_PHRASES).collect()
    )
    lexicon = Lexicon(lexicon.weights, (*EXCEPTIONS, *(r["term"] for r in harmless if r["term"] not in EXCEPTIONS)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(lexicon.features(batch.column("text"))), batch.column("toxic")], names=["x", "y"])

    points = sample.filter("part = 0").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measure, "x double, y int").collect()
    if len({r["y"] for r in points}) < 2:
        points = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measure, "x double, y int").collect()
    lexicon.curve = fit_curve(np.array([r["x"] for r in points]), np.array([r["y"] for r in points], float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return with_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text isn't predicted toxic; one narrow pass, no shuffle.

    A lexicon without terms, learned from labels of one kind, can't tell texts apart and rejects none.
    """
    if not lexicon.weights:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
