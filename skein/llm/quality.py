"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character n-grams; a softmax layer on top gives the
class. It is trained by stochastic gradient descent in numpy on a bounded, documented number of labelled rows. As the
output is linear in the average, every feature is one number once trained, and a text of any length is scored as a sum
over its words; words' sums are remembered in a bounded table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import held_out, materialize, strings, trim

BUCKETS = 1 << 17
DIM = 16
GRAMS = (3, 4)
#: Labelled rows of each class that are learned from, at most.
SAMPLE_PER_CLASS = 1500
EPOCHS = 8
RATE = 0.3
REMEMBERED = 200_000
#: Stands for "the word before is the same", which single words and n-grams can't show.
AGAIN = "\x00again"


def features(word: str) -> list[int]:
    """Hash buckets of a word and of the n-grams of the word with its ends marked."""
    w = f"<{word}>"
    out = [crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in GRAMS:
        out += [crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(w) - n + 1)]
    return out


def bag(text: str | None, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights summing to one) of a whole text."""
    words = (text or "").split()
    counts = Counter(words)
    counts[AGAIN] = sum(map(eq, words, words[1:]))
    sums: Counter[int] = Counter()
    for word, n in counts.items():
        if n:
            fs = known.get(word)
            if fs is None:
                fs = known[word] = features(word)
            for f in fs:
                sums[f] += n
    ids = np.fromiter(sums.keys(), np.int32, len(sums))
    w = np.fromiter(sums.values(), np.float32, len(sums))
    return ids, w / max(w.sum(), 1)


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit on texts with labels 0 and 1; returns what each bucket adds to the log-odds of 1, and the bias.

    Gradient steps are scaled per feature row by the root of its summed squared gradients (AdaGrad).
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    if not texts or len(set(labels)) < 2:  # nothing to tell apart: the one class there is, or even odds
        only = 0.0 if not labels else (4.0 if labels[0] == 1 else -4.0)
        return np.zeros(BUCKETS, np.float32), only
    known: dict[str, list[int]] = {}
    bags = [bag(t, known) for t in texts]
    known.clear()
    seen_e, seen_o, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(bags)):
            ids, w = bags[i]
            rows = emb[ids]
            h = w @ rows
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g_out = np.outer(h, p)
            g_h = out @ p
            seen_o += g_out**2
            seen_b += p**2
            if len(ids):
                seen_e[ids] += w**2 * float(g_h @ g_h) / DIM
                emb[ids] = rows - np.outer(rate * w / np.sqrt(seen_e[ids]), g_h)
            out -= rate * g_out / np.sqrt(seen_o)
            bias -= 0.1 * rate * p / np.sqrt(seen_b)
    return emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


class Scorer:
    """Log-odds of whole texts under a trained model; the table of remembered words is bounded."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.sums = weights, bias, {}

    def __call__(self, text: str) -> float:
        words = text.split()
        sums, total, n = self.sums, 0.0, 0
        if len(sums) > REMEMBERED:
            sums.clear()
        counts = Counter(words)
        counts[AGAIN] = sum(map(eq, words, words[1:]))
        for word, c in counts.items():
            if c:
                v = sums.get(word)
                if v is None:
                    fs = features(word)
                    v = (float(self.weights[fs].sum()), len(fs))
                    if len(word) <= 64:
                        sums[word] = v
                total += c * v[0]
                n += c * v[1]
        return total / max(n, 1) + self.bias


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> list[tuple[str | None, int]]:
    """At most per_class rows of each class (those of smallest id hash), none from the held-out fold."""
    ids = labels.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label"))
    picked = None
    for k in (0, 1):
        some = ids.where(F.col("label") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    picked = materialize(picked, "sample")  # per_class rows a class at most: fit for a broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    got = rows.join(F.broadcast(picked), F.col("id") == F.col("label_id")).select("id", "text", "label")
    # the limit binds where ids repeat in docs
    got = got.orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("text")).limit(2 * per_class).collect()
    return [(r.text, r.label) for r in got]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on the sample; the bias then moves from the sample's class shares to those of all labels outside the fold."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    weights, bias = train([t for t, _ in rows], [k for _, k in rows])
    taken = Counter(k for _, k in rows)
    known = labels.where(~held_out(id_col)).groupBy(F.col(label_col).cast("int").alias("k")).count()
    whole = {r.k: r["count"] for r in known.where("k in (0, 1)").collect()}
    if len(taken) == 2 and len(whole) == 2:
        bias += math.log(whole[1] / whole[0]) - math.log(taken[1] / taken[0])
    return weights, bias


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of docs: id, held_out, score (of class 1, from the text alone) and predicted.

    keep: instead give the rows of docs, with docs' own columns, whose predicted class is 1.
    Defined cases: null and empty texts get the score of the bias; null ids are scored and count as crc32 of the empty
    text; equal rows get equal scores; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the corpus

    def probability(z: float) -> float:
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in (part.slice(i, 1024) for part in batches for i in range(0, part.num_rows, 1024)):
            score = [probability(scorer(x)) for x in strings(b.column(b.schema.names.index("__text") if keep else 2))]
            if keep:
                mask = pa.array([s >= 0.5 for s in score])
                yield b.drop_columns(["__text"]).filter(mask)
                continue
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=["id", "held_out", "score", "predicted"])
        scorer.sums.clear()
        trim()

    if keep:
        with_text = docs.withColumn("__text", F.col(text_col).cast("string"))
        return with_text.mapInArrow(run, docs.schema)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    from skein.session import table

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
