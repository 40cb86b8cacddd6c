"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding takes homoglyphs, accents and digit substitutions to one plain letter, so that
disguised spellings match. The lexicon's words and word beginnings, their weights and the
exception phrases are learned from labelled documents; hits are summed, normalised by
the text's length and turned into a probability by a small logistic model.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialize, returning_memory

# Characters that look like a letter or stand for it; l and i are one class.
LOOKALIKES = {
    "a": "4@аα",
    "b": "8вβ",
    "c": "(сϲ",
    "d": "ԁɗ",
    "e": "3еεё",
    "f": "ƒ",
    "g": "69ɡ",
    "h": "нһ",
    "i": "1!|lіıιӏɩ",
    "j": "ј",
    "k": "кκ",
    "m": "м",
    "n": "пη",
    "o": "0оο",
    "p": "рρ",
    "q": "ԛ",
    "r": "гɾ",
    "s": "5$ѕ",
    "t": "7+тτ",
    "u": "υ",
    "v": "ν",
    "w": "ѡωԝ",
    "x": "хχ",
    "y": "уγ",
    "z": "2ζ",
}
FOLD = str.maketrans({c: to for to, chars in LOOKALIKES.items() for c in chars})
FOLD |= {c: None for c in (*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
NOT_LETTERS = re.compile(r"[\W_]+")
TRAILING = re.compile(r"[!|+(]+(?=\s|$)")


def folded(text: str | None) -> str:
    """Words of plain letters between single spaces, with a space at either end; ' ' for none."""
    # Lower case comes last: compatibility forms decompose to capitals too.
    plain = unicodedata.normalize("NFKD", TRAILING.sub(" ", text or "")).lower().translate(FOLD)
    return f" {NOT_LETTERS.sub(' ', plain).strip()} ".replace("  ", " ")


@dataclass(frozen=True)
class Fit:
    """Bounds of the fit: at most about so many labelled rows of either kind; all their terms that pass count."""

    toxic_rows: int = 5000
    clean_rows: int = 15000
    shortest: int = 4
    longest: int = 10
    certainty: float = 3.2
    least_weight: float = 2.0


@dataclass(frozen=True)
class Lexicon:
    """Weights by term: ' word ' is a whole word, ' stem' a beginning. Hits inside exceptions don't count."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    model: tuple[float, ...] = (-4.0, 1.0, 1.0)
    automaton: object = field(default=None, compare=False)

    def compiled(self) -> "Lexicon":
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return Lexicon(self.weights, self.exceptions, self.model, found)

    def hits(self, text: str) -> dict[int, tuple[float, str]]:
        """The heaviest term at each word start of a folded text, without exceptions."""
        best: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        if self.automaton is not None and len(self.automaton):
            for end, (n, weight) in self.automaton.iter(text):
                start = end - n + 1
                if weight is not None:
                    if weight > best.get(start, (-np.inf, ""))[0]:
                        best[start] = (weight, text[start : end + 1])
                    continue
                # Ends ascend, so what a phrase overlaps was found just before it.
                while spared and spared[-1][1] > start:
                    start = min(start, spared.pop()[0])
                spared.append((start, end))
        if spared and best:
            starts = [a for a, _ in spared]
            best = {s: x for s, x in best.items() if (i := bisect_right(starts, s)) == 0 or s >= spared[i - 1][1]}
        return best

    def features(self, text: str) -> tuple[int, int, float, float, float]:
        """Words, hits, their weight, that by the root of the length, and by the length."""
        words = text.count(" ") - 1 if text.strip() else 0
        best = self.hits(text)
        total = sum(w for w, _ in best.values())
        return words, len(best), total, total / max(words, 1) ** 0.5, 100 * total / max(words, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(x) @ np.array(self.model), -40, 40)))


def design(x: np.ndarray) -> np.ndarray:
    """Model columns from features: constant, weight, and weight by length."""
    return np.stack([np.ones(len(x)), np.log1p(x[:, 2]), np.log1p(x[:, 4])], axis=1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """doc_id, text, toxic and share (of its kind's rows that were taken), from rows not held out.

    Taken by a hash of the id, so that reruns agree; a label without a document is left out.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = {1: min(1.0, fit.toxic_rows / max(counts.get(1, 0), 1)), 0: min(1.0, fit.clean_rows / max(counts.get(0, 0), 1))}
    marks = marks.withColumn("share", F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    marks = marks.where(F.pmod(F.xxhash64("l_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    # At most about toxic_rows + clean_rows ids, whatever the size of the tables.
    taken = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("l_id")).drop("l_id")
    return materialize(taken, "toxic-sample")


def counted(sample: DataFrame, terms_of: object) -> DataFrame:
    """term, toxic and clean: how many of the sample's documents have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = (Counter(), Counter())

        def flush() -> Iterator[pd.DataFrame]:
            terms = list(counts[0].keys() | counts[1].keys())
            if terms:  # a task may have no row of the sample
                yield pd.DataFrame({"term": terms, "toxic": [counts[1][t] for t in terms], "clean": [counts[0][t] for t in terms]})
            counts[0].clear(), counts[1].clear()

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                counts[int(toxic)].update(terms_of(folded(text)))
                if len(counts[0]) + len(counts[1]) > 1 << 17:
                    yield from flush()
        yield from flush()

    by_task = in_small_batches(sample).select("text", "toxic").mapInPandas(returning_memory(run), "term string, toxic long, clean long")
    return by_task.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def word_terms(fit: Fit) -> object:
    def terms(text: str) -> Iterable[str]:
        words = set(text.split())
        return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in range(fit.shortest, min(len(w), fit.longest + 1))}

    return terms


def pair_terms(lexicon: Lexicon) -> object:
    """Word pairs around the lexicon's hits."""

    def terms(text: str) -> Iterable[str]:
        found, compiled = set(), lexicon.compiled()
        for start in compiled.hits(text):
            end = text.index(" ", start + 1)
            before, after = text.rfind(" ", 0, start), text.find(" ", end + 1)
            if before >= 0:
                found.add(text[before : end + 1])
            if after >= 0:
                found.add(text[start : after + 1])
        return found

    return terms


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's method."""
    a, b = design(x), np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        gradient = a.T @ (weight * (y - p)) - ridge * b
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in b)


def learn(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Lexicon:
    """A lexicon from the labelled rows that aren't held out; without any, one that matches nothing.

    A term counts when its log-odds between toxic and clean documents reach least_weight
    and `certainty` standard errors. A word pair around a term is an exception when it is
    as surely a sign of clean documents.
    """
    sample = training_sample(docs, labels, fit)
    # Terms come from two thirds of the sample, the model from the rest, where they weren't picked.
    third = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0
    sample, rest = sample.where(~third), sample.where(third)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    error = fit.certainty * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    terms = counted(sample, word_terms(fit)).withColumn("weight", odds)
    terms = terms.where((odds >= error) & (odds >= fit.least_weight))
    lexicon = Lexicon({r["term"]: r["weight"] for r in terms.collect()})
    if lexicon.weights:
        pairs = counted(sample, pair_terms(lexicon)).where((odds <= -error) & (odds <= -fit.least_weight))
        lexicon = Lexicon(lexicon.weights, frozenset(r["term"] for r in pairs.collect()))
    rows = measured(rest.select("doc_id", "text"), lexicon).drop("terms")
    rows = rows.join(rest.select("doc_id", "toxic", "share").dropDuplicates(["doc_id"]), "doc_id").toPandas()
    if rows["toxic"].nunique() < 2:
        return lexicon
    x = rows[["n_words", "n_hits", "weight", "by_root", "by_length"]].to_numpy(np.float64)
    model = logistic(x, rows["toxic"].to_numpy(np.float64), 1 / rows["share"].to_numpy())
    return Lexicon(lexicon.weights, lexicon.exceptions, model)


def measured(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, n_words, n_hits, weight, by_root, by_length, score and the matched terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon.compiled()
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts = [folded(t) for t in part.column("text").to_pylist()]
                x = np.array([own.features(t) for t in texts], dtype=np.float64)
                terms = [sorted({term.strip() for _, term in own.hits(t).values()}) if hit else [] for t, hit in zip(texts, x[:, 1])]
                counts = [pa.array(x[:, i].astype(np.int64)) for i in (0, 1)]
                columns = [*counts, *[pa.array(x[:, i]) for i in (2, 3, 4)], pa.array(own.score(x)), pa.array(terms, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_words", "n_hits", "weight", "by_root", "by_length", "score", "terms"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_small_batches(keyed).mapInArrow(returning_memory(run), "doc_id long, n_words long, n_hits long, weight double, by_root double, by_length double, score double, terms array<string>")


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, n_hits and the matched terms.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no hits and
    the model's base score; a null doc_id stays null and isn't held out; repeated rows
    score alike; an empty table gives no rows. Whole texts are matched, of any length.
    """
    found = measured(docs, lexicon)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits", "terms")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score_toxicity marks, each by its own text, whatever its doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon.compiled()
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                x = np.array([own.features(folded(t)) for t in part.column("text").to_pylist()], dtype=np.float64).reshape(-1, 5)
                yield part.filter(pa.array(~(np.asarray(own.score(x)) >= threshold)))

    return in_small_batches(docs).mapInArrow(returning_memory(run), docs.schema)
