"""Operator 3, quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Spark counts the vote patterns of all documents (at most 3 ** labellers rows);
expectation-maximisation over those counts estimates how often each labeller
votes what for good and for bad documents.  The posterior of its pattern is a
document's label; a linear scorer over hashed features of words, their shapes
and repetitions learns the labels of a bounded sample (``SAMPLE_ROWS`` rows of
at most ``SAMPLE_BYTES``, in hash order of the id) and scores every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import documents, staged, task, text_or_empty
from tillcast.llm.decontaminate import word_hashes
from tillcast.llm.quality_rules import measures

ABSTAIN, BAD, GOOD = 0, 1, 2
BUCKETS = 1 << 16
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 1 << 16
ROUNDS, STEPS = 200, 300
#: Words added to a text's number of words when its features are averaged.
SHRINK = 20
#: Score from which a document is kept.
THRESHOLD = 0.5
CHUNK_BYTES = 2 << 20  # text read at a time (memory bound only)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Labeller:
    """Votes bad where the SQL condition ``bad`` holds, else good where ``good`` holds."""

    name: str
    bad: str
    good: str

    def column(self) -> Column:
        vote = F.when(F.expr(self.bad), BAD).when(F.expr(self.good), GOOD).otherwise(ABSTAIN)
        return F.coalesce(vote, F.lit(ABSTAIN))


LABELLERS: tuple[Labeller, ...] = (
    Labeller("stop_words", "n_words >= 20 AND n_stop_words < 0.06 * n_words", "n_words >= 10 AND n_stop_words BETWEEN 0.15 * n_words AND 0.45 * n_words"),
    Labeller("symbols", "n_words >= 5 AND n_symbols > 0.2 * n_words", "n_words >= 5 AND n_symbols < 0.05 * n_words"),
    Labeller("capitals", "n_upper > 0.4 * word_chars", "n_words >= 5 AND n_upper < 0.15 * word_chars"),
    Labeller("repetition", "n_words >= 20 AND n_repeat_words > 0.3 * n_words", "n_words >= 20 AND n_repeat_words < 0.15 * n_words"),
    Labeller("vocabulary", "n_words >= 20 AND n_distinct_words < 0.2 * n_words", "n_words >= 20 AND n_distinct_words > 0.4 * n_words"),
    Labeller("word_length", "n_words >= 20 AND (word_chars > 7.2 * n_words OR word_chars < 2 * n_words)",
             "n_words >= 10 AND word_chars BETWEEN 3.5 * n_words AND 6.5 * n_words"),
    Labeller("lines", "n_lines >= 4 AND n_dup_lines > 0.5 * n_lines", "n_lines >= 2 AND n_dup_lines < 0.25 * n_lines"),
)


def votes(docs: DataFrame, labellers: Sequence[Labeller] = LABELLERS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``id_col`` and ``pattern``: the votes as digits of a base-3 number."""
    pattern = F.lit(0).cast("long")
    for i, x in enumerate(labellers):
        pattern = pattern + x.column().cast("long") * (3 ** i)
    return measures(docs, id_col, text_col).select(F.col(id_col), pattern.alias("pattern"))


def pattern_votes(patterns: np.ndarray, labellers: int) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(labellers)) % 3


@dataclass
class LabelModel:
    """Prior of good, and vote probabilities by labeller, class (bad, good) and
    vote, given that it votes: an abstention says nothing (probability 1)."""

    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good given each vote pattern."""
        v = pattern_votes(np.asarray(patterns, dtype=np.int64), len(self.table))
        logs = np.log(self.table)
        like = sum(logs[i][:, v[:, i]] for i in range(len(self.table)))
        odds = np.log(self.prior) - np.log(1 - self.prior) + like[1] - like[0]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Share of a labeller's votes (abstentions apart) that are right."""
        good, bad = self.prior, 1 - self.prior
        right = good * self.table[:, 1, GOOD] + bad * self.table[:, 0, BAD]
        wrong = good * self.table[:, 1, BAD] + bad * self.table[:, 0, GOOD]
        return right / (right + wrong)


def estimate(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    Starts from "one bad vote makes a bad document"; add-one smoothing keeps
    every probability inside (0, 1).  No rows at all give an even model.
    """
    v = pattern_votes(np.asarray(patterns, dtype=np.int64), labellers)
    n = np.asarray(counts, dtype=np.float64)
    good = np.where((v == BAD).any(axis=1), 0.05, 0.95)
    model = LabelModel(0.5, np.ones((labellers, 2, 3)))
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        table = np.ones((labellers, 2, 3))
        for i in range(labellers):
            for vote in (BAD, GOOD):
                table[i, :, vote] += weight[:, v[:, i] == vote].sum(axis=1)
        table[:, :, (BAD, GOOD)] /= table[:, :, (BAD, GOOD)].sum(axis=2, keepdims=True)
        model = LabelModel(float((weight[1].sum() + 1) / (n.sum() + 2)), table)
        new = model.posterior(patterns)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return model


# Classes of bytes for word shapes: letters (also of other scripts) by case,
# digits; any other byte stands for itself.
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[0x30:0x3A], _SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:] = 0x30, 0x41, 0x61, 0x61
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
FEATURES = 4


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32)) ^ np.uint64(kind * 0x9E37)) * _MIX
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of every word (words x FEATURES) and the first word of each text (and the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    edge = np.diff(np.concatenate([[True], _BLANK[data], [True]]).view(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    first = np.searchsorted(starts, bounds)
    h = word_hashes(data, starts, ends)
    size = (ends - starts).astype(np.uint64)
    tail = [_SHAPE[data[np.maximum(ends - k, starts)]] for k in (1, 2, 3)]
    shape = _SHAPE[data[starts]] | tail[0] << np.uint64(8) | tail[1] << np.uint64(16) | tail[2] << np.uint64(24)
    # Words equal to one of the three before it in the same text.
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    again = np.zeros(len(h), dtype=np.uint64)
    for k in (3, 2, 1):
        same = (h[k:] == h[:-k]) & (text[k:] == text[:-k])
        again[k:][same] = k
    return np.stack([_bucket(h, 1), _bucket(shape, 2), _bucket(np.minimum(size, np.uint64(24)), 3), _bucket(again, 4)], axis=1), first


@dataclass
class Scorer:
    """Linear scorer: bias, and the weights of a text's features summed over its
    words and divided by their number plus ``SHRINK``, so that a few words decide little."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of good; 0 for texts without words."""
        found, first = features(texts)
        total = np.concatenate([[0.0], np.cumsum(self.weights[found].sum(axis=1))])
        n = np.diff(first)
        mean = (total[first[1:]] - total[first[:-1]]) / (n + SHRINK)
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(self.bias + mean, -50, 50))), 0.0)


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS) -> Scorer:
    """Logistic regression on posterior labels by full gradient steps (Adam)."""
    w, bias = np.zeros(BUCKETS), 0.0
    y = np.asarray(labels, dtype=np.float64)
    # Each text's distinct features with their shares, some texts at a time.
    text, bucket, share, some = [], [], [], np.zeros(len(texts), dtype=bool)
    for i in range(0, len(texts), 128):
        found, first = features(texts[i:i + 128])
        n = np.diff(first)
        some[i:i + 128] = n > 0
        owner = np.repeat(np.arange(len(n)), n * FEATURES)
        pairs, counts = np.unique(owner * BUCKETS + found.reshape(-1), return_counts=True)
        text.append((pairs // BUCKETS + i).astype(np.int32))
        bucket.append((pairs % BUCKETS).astype(np.int32))
        share.append((counts / (n[pairs // BUCKETS] + SHRINK)).astype(np.float32))
    if not some.any():
        return Scorer(w, bias)
    text, bucket, share = np.concatenate(text), np.concatenate(bucket), np.concatenate(share)
    weight = some / some.sum()
    m1, m2, b1, b2 = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, steps + 1):
        mean = np.bincount(text, weights=w[bucket] * share, minlength=len(texts))
        d = (1 / (1 + np.exp(-np.clip(bias + mean, -50, 50))) - y) * weight
        g = np.bincount(bucket, weights=d[text] * share, minlength=BUCKETS) + 1e-6 * w
        gb = d.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        rate = 0.3 * (1 - 0.9 * step / steps)
        w -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-5)
        bias -= rate * (b1 / (1 - 0.9 ** step)) / (np.sqrt(b2 / (1 - 0.99 ** step)) + 1e-5)
    return Scorer(w, float(bias))


def train(docs: DataFrame, labellers: Sequence[Labeller] = LABELLERS, rows: int = SAMPLE_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, Scorer]:
    """Label model from all documents' votes, scorer from the sample."""
    counted = votes(docs, labellers, id_col, text_col).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    counted.sort(key=lambda r: r["pattern"])
    model = estimate(np.array([r["pattern"] for r in counted], dtype=np.int64), np.array([r["n"] for r in counted]), len(labellers))
    ids = (docs.select(F.col(id_col).alias("k")).filter(F.col("k").isNotNull()).distinct()
           .orderBy(F.xxhash64("k"), "k").limit(rows))
    part = (docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("t")).filter(F.octet_length("t") <= SAMPLE_BYTES)
            .join(F.broadcast(ids), "k").groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t")))
    part = staged(part, "classifier-sample")        # of rows that repeat an id the text of the least hash, read twice
    texts = part.orderBy("k").collect()
    marks = {r["k"]: r["pattern"] for r in votes(part, labellers, "k", "t").collect()}
    y = model.posterior(np.array([marks[r["k"]] for r in texts], dtype=np.int64)) if texts else np.zeros(0)
    return model, fit([r["t"].encode() for r in texts], y)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """Struct ``row`` (the columns of ``docs``) and ``score`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.struct(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in docs.columns]).alias("row"))

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        row = pa.concat_arrays([b.column(0) for b in held])
        p = shared.value.scores([(x or "").encode() for x in pc.struct_field(row, text_col).to_pylist()])
        return pa.RecordBatch.from_arrays([row, pa.array(p)], ["row", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 128):
                held.append(b.slice(i, 128))
                size += held[-1].nbytes
                if size >= CHUNK_BYTES:
                    yield chunk(held)
                    held, size = [], 0
        if held:
            yield chunk(held)

    return rows.mapInArrow(task(run), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labellers: Sequence[Labeller] = LABELLERS, threshold: float = THRESHOLD,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Struct ``row``, ``score`` and ``kept`` (``score >= threshold``) of every row.

    Null, empty and blank texts score 0 and are rejected.  Repeated rows score
    alike; null ids are scored but not sampled; an empty table gives an empty result.
    """
    _, scorer = train(docs, labellers, id_col=id_col, text_col=text_col)
    return score(docs, scorer, text_col).withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    return classify(docs, **options).filter("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document."""
    return classify(documents(spark, sf_dir).select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "score", "kept")
