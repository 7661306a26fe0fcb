"""Toxicity by a counterfactual-regularised linear classifier.

Features are the words of a text and their beginnings and ends, present or
not.  Spark counts them by label over a bounded training sample and keeps the
telling ones; a logistic model is fitted with a penalty on the change of
score when identity terms are swapped for others of their group, so that
mentioning a group does not by itself move a text towards either label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, read

#: Bounds of the fit: labelled rows, and features kept.
SAMPLE_ROWS, FEATURES = 8_000, 20_000
#: A feature needs so many rows and so many standard errors between the labels.
LEAST_ROWS, LEAST_Z = 3, 4.0
#: Strengths of the ridge and of the counterfactual penalty; steps of the fit.
RIDGE, COUNTERFACTUAL, STEPS = 3e-4, 1.0, 300
#: Toxic rows weigh so much more in the fit, being few.
TOXIC_WEIGHT = 1.5
#: Words remembered by one worker at most.
MEMORY = 400_000

#: Identity terms; the terms of a group may stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)
SWAPS = {term: group[(i + 1) % len(group)] for group in IDENTITY for i, term in enumerate(group)}
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_features(word: str) -> list[int]:
    """Hashes of the word, its beginnings and its ends."""
    parts = ["=" + word, *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n), *(f"${word[-n:]}" for n in (4, 5) if len(word) > n)]
    return [xxhash.xxh64_intdigest(p) - (1 << 63) for p in parts]


class Featurer:
    """Features of sets of words; those of a word are remembered."""

    def __init__(self):
        self.memory: dict[str, list[int]] = {}

    def __call__(self, found: set[str]) -> set[int]:
        out: set[int] = set()
        for w in found:
            got = self.memory.get(w)
            if got is None:
                if len(self.memory) > MEMORY:
                    self.memory.clear()
                got = self.memory[w] = word_features(w)
            out.update(got)
        return out


def counterfactual(found: set[str], here: set[int], features: Featurer) -> list[tuple[set[int], set[int]]]:
    """(features that go, features that come) of changes that should leave the score as it is.

    Every identity term is swapped for the next of its group.  A text without
    any gets one put in, against its swap and against none.
    """
    terms = found & SWAPS.keys()
    if terms:
        rest = features(found - terms)
        old, new = rest | features(terms), rest | features({SWAPS[t] for t in terms})
        return [(old - new, new - old)]
    group = IDENTITY[sum(map(len, found)) % len(IDENTITY)]
    first, second = here | features({group[0]}), here | features({group[1]})
    return [(first - second, second - first), (first - here, set())]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, longs = Featurer(), pa.list_(pa.int64())
    types = [pa.int32(), longs, pa.list_(longs), pa.list_(longs)]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for label, text in zip(batch.column(0).slice(at, 256), batch.column(1).slice(at, 256), strict=True):
                found = set(words(text.as_py()))
                here = features(found)
                pairs = counterfactual(found, here, features)
                rows.append((label.as_py(), list(here), [list(a) for a, _ in pairs], [list(b) for _, b in pairs]))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "here", "gone", "come"])


def _fit(rows: list, vocabulary: dict[int, int]) -> tuple[np.ndarray, float]:
    """Weights and intercept: gradient steps on log-loss, ridge and squared score changes."""

    def sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        got = [[vocabulary[f] for f in x if f in vocabulary] for x in lists]
        return np.repeat(np.arange(len(got)), [len(x) for x in got]), np.array([c for x in got for c in x], np.int64)

    y = np.array([r["label"] for r in rows], float)
    at, col = sparse([r["here"] for r in rows])
    gone_at, gone = sparse([x for r in rows for x in r["gone"]])
    come_at, come = sparse([x for r in rows for x in r["come"]])
    pairs, n, size = sum(len(r["gone"]) for r in rows), len(rows), len(vocabulary)
    w, b = np.zeros(size), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    m1, m2 = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(at, w[col], n), -30, 30)))
        miss = (p - y) * np.where(y > 0, TOXIC_WEIGHT, 1.0) / n
        grad = np.bincount(col, miss[at], size) + RIDGE * w
        change = (np.bincount(come_at, w[come], pairs) - np.bincount(gone_at, w[gone], pairs)) * (COUNTERFACTUAL / max(pairs, 1))
        grad += np.bincount(come, change[come_at], size) - np.bincount(gone, change[gone_at], size)
        grad = np.append(grad, miss.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[int, float], float]:
    """Feature weights and the intercept, learnt from ``labels`` (doc_id, toxic).

    At most ``sample_rows`` labelled ids are used, those with the smallest
    hashes; null labels and ids, and labels other than 0 and 1, are not.  A
    document with several labels counts as toxic if any of them is.  Without
    both labels there are no weights, and the score is the toxic share.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # the sample is bounded by sample_rows rows of two numbers
    rows = text.join(F.broadcast(known), "doc_id").select(F.col("label").cast("int").alias("label"), "text")
    seen = cut(rows.mapInArrow(_featured, "label int, here array<long>, gone array<array<long>>, come array<array<long>>"), "labelled")
    n, n1 = seen.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n1 < n:
        share = min(max(n1 / n if n else 0.0, 1e-9), 1 - 1e-9)
        return {}, float(np.log(share / (1 - share)))
    counts = seen.select("label", F.explode("here").alias("f")).groupBy("f").agg(F.count("*").alias("c"), F.sum("label").alias("c1"))
    rate = F.col("c") / n
    z = (F.col("c1") / n1 - (F.col("c") - F.col("c1")) / (n - n1)) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / (n - n1)))
    told = counts.filter((F.col("c") >= LEAST_ROWS) & (F.col("c") < n)).withColumn("z", F.abs(z)).filter(F.col("z") >= LEAST_Z)
    kept = [r[0] for r in told.orderBy(F.desc("z"), "f").limit(FEATURES).select("f").collect()]
    terms = Featurer()(set(SWAPS))
    vocabulary = {f: i for i, f in enumerate(dict.fromkeys([*kept, *sorted(terms)]))}
    weights, intercept = _fit(_bounded(seen, list(vocabulary)), vocabulary)
    return {f: float(weights[i]) for f, i in vocabulary.items() if abs(weights[i]) > 1e-4}, float(intercept)


def _bounded(seen: DataFrame, vocabulary: list[int]) -> list:
    """The sample's rows with the vocabulary's features alone, on the driver: bounded by the sample and the vocabulary."""
    known = frozenset(vocabulary)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, here, gone, come = (c.to_pylist() for c in batch.columns)
            here = [[f for f in x if f in known] for x in here]
            gone, come = ([[[f for f in x if f in known] for x in xs] for xs in side] for side in (gone, come))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array(here, longs), pa.array(gone, pa.list_(longs)), pa.array(come, pa.list_(longs))],
                ["label", "here", "gone", "come"],
            )

    return seen.mapInArrow(keep, seen.schema).collect()


class Scorer:
    """The model's score of a text; words' own features are remembered."""

    def __init__(self, weights: dict[int, float], intercept: float):
        self.weights, self.intercept, self.memory = weights, intercept, {}

    def __call__(self, text: str | None) -> float:
        hit: set[int] = set()
        for w in set(words(text)):
            got = self.memory.get(w)
            if got is None:
                if len(self.memory) > MEMORY:
                    self.memory.clear()
                got = self.memory[w] = tuple(f for f in word_features(w) if f in self.weights)
            if got:
                hit.update(got)
        z = self.intercept + sum(sorted(self.weights[f] for f in hit))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _scores(weights: dict[int, float], intercept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, intercept)
        for batch in batches:
            scores = [scorer(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not call toxic."""
    weights, intercept = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, intercept)
        for batch in batches:
            yield batch.filter(pa.array([scorer(text.as_py()) < 0.5 for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, weights: dict[int, float], intercept: float) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text).

    Null, empty and wordless texts score as the intercept says.  Repeated rows
    score alike; rows of any length are read whole; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(weights, intercept), "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; a null id is held out."""
    weights, intercept = train(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    found = score(docs, weights, intercept)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), read(spark, sf_dir, "labels"))
