"""Operator 9, toxicity: a bidirectional gated recurrent network with attention
pooling over character and word inputs, trained here in numpy.

Input of a step: the embedding of the hashed word beside the sum of its hashed
character n-grams' embeddings over the root of their number.  Both directions run over windows of ``WINDOW``
words, each window starting ``STRIDE`` words after the one before, over the
whole text; attention pools a window's states to one logit.  A document scores
as its highest window.

Training uses a bounded sample of labelled rows (``SAMPLE_POSITIVE`` and
``SAMPLE_NEGATIVE`` rows of at most ``SAMPLE_BYTES`` each, in hash order of
the id).  Labels belong to whole documents, so positive windows are chosen
anew every ``REVISE`` steps as those that score highest in their documents,
and half of the negative ones as the hardest.  Positive documents are drawn
alike whatever their length.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import documents, task, text_or_empty
from tillcast.llm.decontaminate import word_hashes, word_spans

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 12, 8, 8
TABLE = 1 << 15
GRAMS = (3, 5, 8)
SAMPLE_POSITIVE, SAMPLE_NEGATIVE, SAMPLE_BYTES = 1200, 2400, 1 << 15
STEPS, REVISE, BATCH = 900, 150, 128
THRESHOLD = 0.3
#: Text bytes read and windows scored at a time (memory bounds only).
CHUNK_BYTES, CHUNK_WINDOWS = 1 << 20, 2048
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return ((h ^ (h >> np.uint64(29))) % np.uint64(TABLE)).astype(np.int32)


class Words:
    """Words of some texts: number of each word in a list of distinct words, and
    the word and n-gram buckets of the distinct ones."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        low, starts, ends = word_spans(data)
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(starts, bounds)  # first word of each text, and the end
        h = word_hashes(low, starts, ends)
        values, index, self.number = np.unique(h, return_index=True, return_inverse=True)
        self.word = _bucket(values)
        s, e = starts[index], ends[index]
        # Bytes of each distinct word between two blanks: its characters' n-grams
        # with both edges.
        size = e - s + 2
        begin = np.cumsum(size) - size
        total = int(size.sum())
        at = np.arange(total) - np.repeat(begin, size)
        flat = low[np.clip(np.repeat(s, size) + at - 1, 0, len(low) - 1)].astype(np.uint64) if total else np.zeros(0, np.uint64)
        flat[(at == 0) | (at == np.repeat(size, size) - 1)] = 32
        left = np.repeat(size, size) - at  # bytes from here to the word's end
        grams, owner = [], []
        for n in GRAMS:
            g = np.full(total, n, dtype=np.uint64)
            for k in range(n):
                g = g * np.uint64(257) + np.concatenate([flat[k:], np.zeros(min(k, total), np.uint64)])
            ok = np.nonzero(left >= n)[0]
            grams.append(_bucket(g[ok]))
            owner.append(np.repeat(np.arange(len(s)), size)[ok])
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.grams = np.concatenate(grams)[order]
        self.count = np.bincount(owner, minlength=len(s))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and number of words of every window."""
        n = np.diff(self.first)
        k = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), k)
        j = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
        start = self.first[text] + j * STRIDE
        return text, start, np.minimum(WINDOW, self.first[text + 1] - start)


def _segments(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of all members of ragged runs, run by run."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes. ``wx``, ``wh``, ``b`` hold both directions."""

    NAMES = ("word", "char", "wx", "wh", "b", "u", "v", "c")

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        f = lambda *s, k=0.1: (g.standard_normal(s) * k).astype(np.float32)
        dim = WORD_DIM + CHAR_DIM
        self.word, self.char = f(TABLE, WORD_DIM), f(TABLE, CHAR_DIM, k=0.3)
        self.wx, self.wh = f(2, dim, 3 * HIDDEN, k=0.4), f(2, HIDDEN, 3 * HIDDEN, k=0.3)
        self.b = np.zeros((2, 1, 3 * HIDDEN), dtype=np.float32)
        self.u, self.v, self.c = f(2 * HIDDEN, k=0.3), f(2 * HIDDEN, k=0.3), np.zeros(1, dtype=np.float32)

    def inputs(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of distinct words ``which``; their n-grams and numbers of them."""
        first = (np.cumsum(words.count) - words.count)[which]
        count = words.count[which]
        grams = words.grams[_segments(first, count)]
        chars = np.zeros((len(which), CHAR_DIM), dtype=np.float32)
        some = count > 0
        if some.any():
            chars[some] = np.add.reduceat(self.char[grams], (np.cumsum(count) - count)[some], axis=0) / np.sqrt(count[some])[:, None]
        return np.concatenate([self.word[words.word[which]], chars], axis=1), grams, count

    def states(self, gx: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """gx (2, T, B, 3H) in each direction's order, mask (2, T, B, 1) -> (2, T, B, H)."""
        h = np.zeros((2, gx.shape[2], HIDDEN), dtype=np.float32)
        out = np.empty((2, gx.shape[1], gx.shape[2], HIDDEN), dtype=np.float32)
        for t in range(gx.shape[1]):
            a = gx[:, t]
            gh = h @ self.wh
            zr = _sigmoid(a[..., :2 * HIDDEN] + gh[..., :2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            n = np.tanh(a[..., 2 * HIDDEN:] + r * gh[..., 2 * HIDDEN:])
            m = mask[:, t] * (1 - z)
            new = h + m * (n - h)
            if keep is not None:
                keep.append((h, z, r, n, gh[..., 2 * HIDDEN:], m))
            out[:, t] = h = new
        return out

    def logits(self, table: np.ndarray, index: np.ndarray, sizes: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """One logit per window. ``table`` (U, 2, 3H): projected inputs; ``index`` (B, T)."""
        steps = index.shape[1]
        mask = (np.arange(steps)[:, None] < sizes)[..., None].astype(np.float32)  # (T, B, 1)
        both = np.stack([mask, mask[::-1]])
        it = index.T
        gx = np.stack([table[it, 0], table[it[::-1], 1]])
        keep = [] if trace is not None else None
        s = self.states(gx, both, keep)
        h = np.concatenate([s[0], s[1, ::-1]], axis=-1)  # (T, B, 2H)
        e = np.where(mask[..., 0] > 0, h @ self.u, -1e9)
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, h)
        if trace is not None:
            trace.update(keep=keep, h=h, a=a, pooled=pooled, both=both)
        return pooled @ self.v + self.c[0]

    def table(self, x: np.ndarray) -> np.ndarray:
        return (np.einsum("ue,dek->udk", x, self.wx) + self.b[:, 0]).astype(np.float32)

    def gradients(self, words: Words, index: np.ndarray, sizes: np.ndarray, labels: np.ndarray,
                  rng: np.random.Generator) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy by back-propagation through time."""
        which, inverse = np.unique(index, return_inverse=True)
        inverse = inverse.reshape(index.shape)
        x, grams, count = self.inputs(words, which)
        # Drop some words' own embeddings so that characters are learnt as well.
        drop = (rng.random(len(which)) > 0.3).astype(np.float32)[:, None]
        x[:, :WORD_DIM] *= drop
        trace: dict = {}
        y = self.logits(self.table(x), inverse, sizes, trace)
        d = ((_sigmoid(y) - labels) / len(labels)).astype(np.float32)
        h, a, pooled = trace["h"], trace["a"], trace["pooled"]
        g = {"v": pooled.T @ d, "c": np.array([d.sum()], dtype=np.float32)}
        dp = d[:, None] * self.v
        da = np.einsum("bh,tbh->tb", dp, h)
        de = a * (da - (a * da).sum(axis=0))
        dh_all = a[..., None] * dp + de[..., None] * self.u
        g["u"] = np.einsum("tb,tbh->h", de, h)
        ds = np.stack([dh_all[..., :HIDDEN], dh_all[::-1, :, HIDDEN:]])  # each direction's order
        dgx = np.empty((2, *h.shape[:2], 3 * HIDDEN), dtype=np.float32)
        g["wh"] = np.zeros_like(self.wh)
        dh = np.zeros_like(ds[:, 0])
        wt = self.wh.transpose(0, 2, 1)
        for t in range(h.shape[0] - 1, -1, -1):
            before, z, r, n, ghn, m = trace["keep"][t]
            dh = dh + ds[:, t]
            dz = -dh * (n - before) * trace["both"][:, t] * z * (1 - z)
            dn = dh * m * (1 - n * n)
            dr = dn * ghn * r * (1 - r)
            dgh = np.concatenate([dz, dr, dn * r], axis=-1)
            dgx[:, t] = np.concatenate([dz, dr, dn], axis=-1)
            g["wh"] += before.transpose(0, 2, 1) @ dgh
            dh = dh * (1 - m) + dgh @ wt
        dgx[1] = dgx[1, ::-1].copy()  # back to the words' order
        flat = dgx.reshape(2, -1, 3 * HIDDEN)
        g["b"] = flat.sum(axis=1, keepdims=True)
        # Sum the gradients of equal words, then go on to the tables.
        at = inverse.T.reshape(-1)
        order = np.argsort(at, kind="stable")
        first = np.concatenate([[0], np.nonzero(np.diff(at[order]))[0] + 1])
        per_word = np.add.reduceat(flat[:, order], first, axis=1)  # (2, U, 3H)
        g["wx"] = np.stack([x.T @ per_word[0], x.T @ per_word[1]])
        dx = per_word[0] @ self.wx[0].T + per_word[1] @ self.wx[1].T
        g["word"] = np.zeros_like(self.word)
        np.add.at(g["word"], words.word[which], dx[:, :WORD_DIM] * drop)
        g["char"] = np.zeros_like(self.char)
        np.add.at(g["char"], grams, np.repeat(dx[:, WORD_DIM:] / np.sqrt(np.maximum(count, 1))[:, None], count, axis=0).astype(np.float32))
        return g

    def scores(self, words: Words, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of each window."""
        if not len(start):
            return np.zeros(0)
        table = self.table(self.inputs(words, np.arange(len(words.word)))[0])
        out = []
        for i in range(0, len(start), CHUNK_WINDOWS):
            s = slice(i, i + CHUNK_WINDOWS)
            at = np.minimum(start[s][:, None] + np.arange(WINDOW), len(words.number) - 1)
            out.append(_sigmoid(self.logits(table, words.number[at], sizes[s]).astype(np.float64)))
        return np.concatenate(out)


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
    """Fit a network to labelled texts. Without words, or with a single label
    value, it stays untrained with that value as its only answer."""
    net, rng = Network(), np.random.default_rng(seed)
    words = Words(texts) if texts else None
    if words is None or not len(words.number) or labels.min() == labels.max():
        net.v[:] = 0
        net.c[:] = 4.0 if len(labels) and labels.min() == 1 else -4.0
        return net
    text, start, sizes = words.windows()
    y = labels[text].astype(np.float32)
    positive, negative = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    if not len(positive) or not len(negative):
        net.v[:] = 0
        net.c[:] = 4.0 if len(positive) else -4.0
        return net
    def share(at: np.ndarray) -> np.ndarray:
        """Chance of each window: documents alike, then their windows alike."""
        w = 1 / np.bincount(text[at])[text[at]]
        return w / w.sum()

    chosen, hard = positive, negative
    chance = share(chosen)
    first = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    second = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    third = BATCH // 3
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(chosen, third, p=chance), rng.choice(negative, BATCH - 2 * third), rng.choice(hard, third)])
        at = np.minimum(start[pick][:, None] + np.arange(WINDOW), len(words.number) - 1)
        g = net.gradients(words, words.number[at], sizes[pick], y[pick], rng)
        rate = 0.02 * min(1, step / 50) * (1 - 0.9 * step / steps)
        for k in net.NAMES:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] * g[k] - second[k])
            value = getattr(net, k)
            value -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
            if k in ("word", "char"):
                value *= 1 - 0.02 * rate
        if step % REVISE == 0 and step < steps:
            p = net.scores(words, start[positive], sizes[positive])
            best = np.zeros(len(texts))
            np.maximum.at(best, text[positive], p)
            chosen = positive[p >= np.maximum(best[text[positive]] - 1e-9, np.minimum(best[text[positive]], 0.9))]
            chance = share(chosen)
            q = net.scores(words, start[negative], sizes[negative])
            hard = negative[np.argsort(-q)[:max(BATCH, len(negative) // 20)]]
    return net


def held_out(id_col: Column) -> Column:
    """Whether a row's labels must not be learnt."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, positives: int = SAMPLE_POSITIVE, negatives: int = SAMPLE_NEGATIVE,
           max_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Bounded sample of labelled texts outside the held-out rows.  Ids are
    chosen from the labels alone, so the texts join a bounded broadcast side."""
    marks = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id")))
    ids = (marks.filter("toxic = 1").orderBy("h").limit(positives)
           .union(marks.filter("toxic = 0").orderBy("h").limit(negatives)).select(F.col("doc_id").alias("id"), "toxic"))
    rows = (docs.select("doc_id", F.lower(text_or_empty("text")).alias("text")).filter(F.octet_length("text") <= max_bytes)
            .join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
            # Of rows that repeat an id the text of the least hash.
            .groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).collect())
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"].encode() for r in rows], np.array([r["toxic"] for r in rows], dtype=np.int64)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (highest window), ``n_windows`` and the words
    [from, to) of the highest window.  A null text, and one without words, has no window and scores 0.
    Repeated rows score alike; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col(id_col).alias(id_col), F.lower(text_or_empty(text_col)).alias("text"))

    def chunk(part: pa.Table) -> pa.RecordBatch:
        words = Words([t.encode() for t in part.column("text").to_pylist()])
        text, start, sizes = words.windows()
        p = shared.value.scores(words, start, sizes)
        best, count = np.zeros(part.num_rows), np.bincount(text, minlength=part.num_rows)
        at = np.zeros(part.num_rows, dtype=np.int64)
        if len(p):
            order = np.lexsort((-np.arange(len(p)), p, text))  # highest last, first of equals last
            last = order[np.cumsum(count)[count > 0] - 1]
            best[count > 0], at[count > 0] = p[last], last
        begin = (start[at] - words.first[:-1]) if len(p) else at
        begin = np.where(count > 0, begin, 0)
        end = begin + np.where(count > 0, sizes[at] if len(p) else 0, 0)
        ids = part.column(0).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, pa.array(best), pa.array(count.astype(np.int64)),
             pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64))],
            [id_col, "score", "n_windows", "from_word", "to_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 64):
                held.append(b.slice(i, 64))
                size += held[-1].column("text").nbytes
                if size >= CHUNK_BYTES:
                    yield chunk(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield chunk(pa.Table.from_batches(held))

    return rows.mapInArrow(task(run), T.StructType([rows.schema[id_col], T.StructField("score", T.DoubleType()),
                                              *[T.StructField(c, T.LongType()) for c in ("n_windows", "from_word", "to_word")]]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: score and prediction of every document."""
    docs = documents(spark, sf_dir)
    net = train(*sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                   (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
