"""Language identification with hyperdimensional profiles.

Each letter has a random vector of DIM entries of +1 or -1. A trigram's vector binds its letters' vectors, permuted by
their place, by element-wise product; a text's vector is the sum (bundle) of its trigrams' vectors, and a language's
prototype the bundle of its texts. A text gets the language of the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import held_out, materialize, strings

DIM = 2048
#: Letters beyond this share vectors, by their code point's remainder.
LETTERS = 1023
SEED = 11
#: Rows that are learned from, per language, at most.
SAMPLE_PER_LANG = 512
SHARES = 64
#: Letters of the texts that are counted together.
TOGETHER = 1_000_000
UNKNOWN = "und"


@lru_cache(1)
def _symbol_of() -> np.ndarray:
    """Code point -> 0 for all but letters, else the letter's number from 1."""
    return np.array([1 + i % LETTERS if chr(i).isalpha() else 0 for i in range(0x110000)], np.int64)


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the letters for each of the three places."""
    base = np.random.default_rng(SEED).integers(0, 2, (LETTERS + 1, DIM), np.int8) * 2 - 1
    return np.roll(base, 2, 1), np.roll(base, 1, 1), base


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    a, b, c = _letters()
    return (a[grams >> 20] * b[grams >> 10 & 1023] * c[grams & 1023]).astype(np.float32)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram, count) of whole texts. Trigrams are centred on a letter; what isn't a letter is a gap."""
    symbol = _symbol_of()
    rows, codes = [], []
    for i, text in enumerate(texts):
        s = symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate(([0], s, [0]))
        at = np.flatnonzero(s[1:-1])
        codes.append(s[at] << 20 | s[at + 1] << 10 | s[at + 2])
        rows.append(np.full(len(at), i, np.int64))
    if not codes:
        return (np.empty(0, np.int64),) * 3
    both, n = np.unique(np.concatenate(rows) << 30 | np.concatenate(codes), return_counts=True)
    return both >> 30, both & (1 << 30) - 1, n


def text_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, number of trigrams) of the texts."""
    row, gram, n = gram_counts(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    kinds, column = np.unique(gram, return_inverse=True)
    for i in range(0, len(kinds), 4096):
        some = (column >= i) & (column < i + 4096)
        counts = np.zeros((len(texts), min(4096, len(kinds) - i)), np.float32)
        counts[row[some], column[some] - i] = n[some]
        out += counts @ gram_vectors(kinds[i : i + 4096])
    return out, np.bincount(row, n, len(texts))


def _packed(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most 128 texts and about TOGETHER characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j - i < 128 and (j == i or size + len(texts[j]) <= TOGETHER):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def prototypes(texts: list[str | None], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, scaled to length one. Each text counts by its trigrams' shares."""
    names = sorted(set(langs))
    sums = np.zeros((len(names), DIM), np.float64)
    texts = [t or "" for t in texts]
    for i, j in _packed(texts):
        v, n = text_vectors(texts[i:j])
        for k in range(i, j):
            if n[k - i]:
                sums[names.index(langs[k])] += v[k - i] / np.sqrt(n[k - i])
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    good = length[:, 0] > 0
    return [x for x, g in zip(names, good, strict=True) if g], (sums[good] / length[good]).astype(np.float32)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Prototypes from at most about per_lang rows of each language (smallest id hashes), none from the held-out fold."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("held"))
    known = rows.where("lang is not null and not held")
    # every language is dealt to SHARES keys with a limit each, which is applied before the exchange too, so the rows of
    # a common language don't meet in one task
    order = Window.partitionBy("lang", "share").orderBy(F.xxhash64("id"), "id")
    share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SHARES)).alias("share")
    ids = known.select("id", "lang", share).withColumn("k", F.row_number().over(order)).where(F.col("k") <= -(-per_lang // SHARES))
    ids = materialize(ids.select(F.col("id").alias("picked_id"), F.col("lang").alias("picked_lang")), "sample")
    got = known.join(ids, (F.col("id").eqNullSafe(F.col("picked_id"))) & (F.col("lang") == F.col("picked_lang"))).select("text", "lang", "id")
    got = got.groupBy("id", "lang").agg(F.min("text").alias("text")).orderBy("lang", "id").collect()
    return prototypes([r.text for r in got], [r.lang for r in got])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred and score (the cosine, from 0 to 1).

    Defined cases: null texts and texts without a letter give und with score 0, as does everything if nothing was
    learned; ties go to the language that sorts first; null ids count as crc32 of the empty text; equal rows get equal
    results; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vector for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, protos = shared.value
        for b in batches:
            texts = strings(b.column(2))
            lang, score = [], []
            for i, j in _packed(texts):
                if not names:
                    lang += [UNKNOWN] * (j - i)
                    score += [0.0] * (j - i)
                    continue
                v, n = text_vectors(texts[i:j])
                length = np.linalg.norm(v, axis=1)
                cos = (v @ protos.T) / np.maximum(length, 1e-9)[:, None]
                best = cos.argmax(1)
                for k in range(j - i):
                    found = n[k] > 0
                    lang.append(names[best[k]] if found else UNKNOWN)
                    score.append(float(min(1.0, max(0.0, cos[k, best[k]]))) if found else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    from skein.session import table

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
