"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF rows, with document frequencies counted over the whole corpus; a distributed randomised
SVD (subspace iteration on sketches) gives a latent space of RANK dimensions; windows of every document are folded into
it and compared with the passages by cosine. Candidates are settled by the longest common subsequence of words; where it
covers the passage only in part, as in a paraphrase, the passage's last words (its answer) must be there too. Items too
short for that are matched exactly, as runs of words.

One model (terms, document frequencies, latent space) covers the whole benchmark, and a passage's thresholds are its own,
so what is found doesn't depend on how passages are dealt to blocks.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize, parts, strings, trim

RANK, OVERSAMPLE, ROUNDS, SEED = 128, 16, 3, 5
#: Passages that are searched for at a time; a larger benchmark is searched for in blocks of about so many, each a pass.
BLOCK_PASSAGES = 20_000
#: Words of a passage at most; longer items give overlapping passages. Items of fewer words than LEAST are matched exactly,
#: those of fewer than INSIDE only as a whole line, since two words are no passage of a text.
PASSAGE, LEAST, INSIDE = 64, 5, 3
#: Words of a step; windows are of 2 and 4 steps.
STEP = 12
COSINE = 0.6
#: Shares of a passage's words in the common subsequence: enough alone, and enough together with the answer.
COPIED, PARAPHRASED, ANSWERED = 0.75, 0.6, 0.8
ANSWER_WORDS = 8
#: A copy or paraphrase keeps many of a passage's neighbouring word pairs. A window is compared if those of its pairs
#: (neighbours and next but one) that some passage has weigh this share of the lightest passage's neighbouring pairs.
PAIRS = 0.45
PAIR_SLOTS = 1 << 22
REMEMBERED = 300_000

#: What is cut from the ends of a word: ASCII and common typographic marks.
MARKS = string.punctuation + "«»“”„‘’‚…–—·•¡¿。、，！？：；（）「」『』《》〈〉"
#: Letters of scripts without spaces between words (Thai to Khmer, kana, Han): each counts as a word.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def spaced(text: str) -> str:
    return text if text.isascii() or UNSPACED.search(text) is None else UNSPACED.sub(r" \1 ", text)


def normal(word: str) -> str:
    """A word as compared: lower case, without marks at its ends ('' if nothing is left)."""
    return word.lower().strip(MARKS)


def words_in(text: str | None) -> list[str]:
    return [w for w in map(normal, spaced(text or "").split()) if w]


def passages_of(text: str | None) -> list[list[str]]:
    """The passages of an item; one shorter than LEAST words is a passage of its own, matched exactly."""
    words = words_in(text)
    if len(words) <= PASSAGE:
        return [words] if words else []
    half = PASSAGE // 2
    return [words[i : i + PASSAGE] for i in range(0, len(words) - half, half)]


class Vocabulary(dict):
    """Raw word -> number of its normal form, or the number of terms for words outside, or one more for mere marks;
    remembers what it met, bounded."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.terms = {t: i for i, t in enumerate(terms)}
        self.outside = len(terms)

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        i = self.terms.get(word)
        if i is None:
            bare = normal(word)
            i = self.terms.get(bare, self.outside) if bare else self.outside + 1
        self[word] = i
        return i

    def ids(self, text: str) -> np.ndarray:
        """Numbers of a text's words; words that are nothing but marks are left out, as in passages."""
        words = spaced(text).split()
        out = np.array(list(map(self.__getitem__, words)), np.int32)
        kept = out <= self.outside
        return out if kept.all() else out[kept]


def terms_in(text: str, terms: dict[str, int]) -> set[str]:
    """The terms that a text holds; only words with a mark at an end are looked at one by one."""
    words = set(spaced(text).lower().split())
    marked = {w.strip(MARKS) for w in words if w[-1] in MARKS or w[0] in MARKS}
    # of the other words none changes by stripping
    return (terms.keys() & words) | (terms.keys() & marked)


def document_counts(docs: DataFrame, terms: list[str], text_col: str) -> tuple[np.ndarray, int]:
    """(documents that hold each term, documents), over all of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = {t: i for i, t in enumerate(shared.value)}
        counts, n = Counter(), 0
        for b in batches:
            for text in strings(b.column(0)):
                n += 1
                counts.update(terms_in(text, terms))
        counts = np.array([*(counts[t] for t in shared.value), n], np.int64)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["term", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term int, n long")
    got = rows.groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the benchmark
    df = np.zeros(len(terms) + 1, np.int64)
    for r in got:
        df[r.term] = r.n
    return df[:-1], int(df[-1])


def tf_idf(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights of length one) of a passage given by its words' numbers."""
    ids, n = np.unique(words, return_counts=True)
    w = (1 + np.log(n)) * idf[ids]
    return ids, (w / max(np.linalg.norm(w), 1e-12)).astype(np.float32)


def randomised_svd(items: DataFrame, terms: list[str], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (terms x rank at most) of the TF-IDF rows of items' passages.

    items has the column text. Every round sends a sketch (terms x (rank + oversample)) to the tasks, which add up
    A'(A X) over their own passages; the sums are merged by term on the executors, so the driver gets one row a term.
    """
    sc = items.sparkSession.sparkContext
    n = parts(items.sparkSession)
    x = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(terms), min(rank + OVERSAMPLE, len(terms)))))[0].astype(np.float32)
    numbers = {t: i for i, t in enumerate(terms)}
    fixed = sc.broadcast((numbers, idf))

    def rows_of(batches: Iterator[pa.RecordBatch]):
        numbers, idf = fixed.value
        for b in batches:
            for text in strings(b.column(0)):
                for words in passages_of(text):
                    yield tf_idf(np.array([numbers[w] for w in words]), idf)

    def pass_over(sketch: Any, gram: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = sketch.value
            width = x.shape[1]
            sums = np.zeros((width, width) if gram else x.shape, np.float32)
            hit = np.zeros(len(sums), bool)
            for ids, w in rows_of(batches):
                y = w @ x[ids]
                if gram:
                    sums += np.outer(y, y)
                    hit[:] = True
                else:
                    sums[ids] += np.outer(w, y)
                    hit[ids] = True
            some = np.flatnonzero(hit)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([r.tobytes() for r in sums[some]], pa.binary())], names=["term", "row"])

        return run

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for t, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(r, np.float32)
                sums[t] = sums[t] + v if t in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["term", "row"])

    def summed(x: np.ndarray, gram: bool) -> np.ndarray:
        sketch = sc.broadcast(x)
        got = items.select("text").mapInArrow(pass_over(sketch, gram), "term int, row binary").repartition(n, "term").mapInArrow(merge, "term int, row binary").collect()
        out = np.zeros((x.shape[1] if gram else len(x), x.shape[1]), np.float32)
        for r in got:
            out[r.term] = np.frombuffer(r.row, np.float32)
        sketch.unpersist()
        return out

    for _ in range(ROUNDS):
        x = np.linalg.qr(summed(x, False))[0]
    values, turn = np.linalg.eigh(summed(x, True).astype(np.float64))
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-9 * max(values.max(), 1e-12)]
    return (x @ turn[:, best]).astype(np.float32)


def common_subsequence(a: list[int] | np.ndarray, b: list[int] | np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Searcher:
    """Finds a block's passages in texts. base: terms, idf, latent of the whole benchmark; block: rows, item, words."""

    def __init__(self, base: dict, block: dict, vocabulary: Vocabulary | None = None):
        self.m = block
        self.vocabulary = vocabulary or Vocabulary(base["terms"])
        idf = base["idf"].astype(np.float32)
        self.latent = np.vstack([base["latent"] * idf[:, None], np.zeros((1, base["latent"].shape[1]), np.float32)])
        self.times = [Counter(w) for w in block["words"]]
        self.mass = np.append(idf, np.float32(0))
        self.pairs = np.zeros(PAIR_SLOTS, bool)
        self.weights = np.full(len(block["words"]), np.inf)
        self.sets: list[set] = []
        self.exact: dict[int, dict[bytes, list[int]]] = {}
        for p, w in enumerate(map(np.array, block["words"])):
            self.sets.append(set(zip(w[:-1].tolist(), w[1:].tolist(), strict=True)) | set(zip(w[:-2].tolist(), w[2:].tolist(), strict=True)))
            if len(w) < LEAST:
                self.exact.setdefault(len(w), {}).setdefault(w.astype(np.int32).tobytes(), []).append(p)
                continue
            self.pairs[self._slots(w[:-1], w[1:])] = True
            self.pairs[self._slots(w[:-2], w[2:])] = True
            self.weights[p] = float((self.mass[w[:-1]] + self.mass[w[1:]]).sum())
        #: What a window must hold for the lightest passage; each passage asks for its own share when it is settled.
        self.least = PAIRS * self.weights.min(initial=np.inf)

    def short(self, text: str, ids: np.ndarray) -> set[int]:
        """Short passages that stand in a text, word for word; those under INSIDE words as a line of it."""
        found: set[int] = set()
        for n, known in self.exact.items():
            if n >= INSIDE:
                first = np.array(sorted({int(np.frombuffer(k, np.int32)[0]) for k in known}))
                for at in np.flatnonzero(np.isin(ids[: max(0, len(ids) - n + 1)], first)):
                    found.update(known.get(ids[at : at + n].astype(np.int32).tobytes(), ()))
        lines = {n: known for n, known in self.exact.items() if n < INSIDE}
        if lines:
            for line in text.split("\n"):
                if len(line) < 400:
                    got = self.vocabulary.ids(line)
                    found.update(lines.get(len(got), {}).get(got.astype(np.int32).tobytes(), ()))
        return found

    @staticmethod
    def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) * 1_000_003 + b) & PAIR_SLOTS - 1

    def __call__(self, text: str) -> list[tuple[int, float, float]]:
        """(item number, share of the passage in the common subsequence, cosine) of the items that a text holds."""
        ids = self.vocabulary.ids(text)
        found = {int(self.m["item"][p]): (1.0, 1.0) for p in self.short(text, ids)} if self.exact else {}
        if len(ids) >= LEAST and self.least < np.inf:
            self._search(ids, found)
        return [(i, *x) for i, x in found.items()]

    def _search(self, ids: np.ndarray, found: dict[int, tuple[float, float]]) -> None:
        m, n = self.m, len(ids)
        steps = -(-n // STEP)
        padded = np.full(steps * STEP, self.vocabulary.outside, np.int32)
        padded[:n] = ids
        padded = padded.reshape(steps, STEP)
        idf = self.mass[ids]
        weight = np.zeros(steps * STEP, np.float32)
        for gap in (1, 2):
            a, b = ids[:-gap], ids[gap:]
            hit = np.flatnonzero(self.pairs[self._slots(a, b)] & (a != self.vocabulary.outside))
            weight[hit] += idf[hit] + idf[hit + gap]
        held = np.concatenate(([0], np.cumsum(weight.reshape(steps, STEP).sum(1))))
        near = held[np.minimum(np.arange(steps) + 4, steps)] - held[:-1] >= self.least
        if not near.any():
            return
        # steps of windows that can matter
        needed = np.zeros(steps + 4, bool)
        for k in range(4):
            needed[k : k + steps] |= near
        needed = needed[:steps]
        sums = np.zeros((steps + 4, self.latent.shape[1]), np.float32)
        if needed.any():
            inside = np.flatnonzero((padded != self.vocabulary.outside) & needed[:, None])
            of = inside // STEP
            firsts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1))
            sums[of[firsts]] = np.add.reduceat(self.latent[padded.ravel()[inside]], firsts, axis=0)
        tried: set[tuple[int, int]] = set()
        two = sums[:-1] + sums[1:]
        four = two[:-2] + two[2:]
        for width, windows in ((2, two[:steps]), (4, four[:steps])):
            starts = np.flatnonzero(near)
            for i in range(0, len(starts), 4096):
                at = starts[i : i + 4096]
                w = windows[at]
                length = np.linalg.norm(w, axis=1)
                cos = (w @ m["rows"].T) / np.maximum(length, 1e-9)[:, None]
                for r, p in zip(*np.nonzero(cos >= COSINE), strict=True):
                    first, p = int(at[r]), int(p)
                    item = int(m["item"][p])
                    if found.get(item, (0, 0))[0] >= 1 or (first // 2, p) in tried:
                        continue
                    tried.add((first // 2, p))
                    share = self._settle(ids, first * STEP, width * STEP, p)
                    if share and share > found.get(item, (0, 0))[0]:
                        found[item] = (share, float(cos[r, p]))

    def _held(self, around: np.ndarray, p: int) -> float:
        held, own = 0.0, self.sets[p]
        for gap in (1, 2):
            a, b = around[:-gap], around[gap:]
            held += sum(float(self.mass[x] + self.mass[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True) if (x, y) in own)
        return held

    def _settle(self, ids: np.ndarray, start: int, width: int, p: int) -> float:
        """Share of passage p in the common subsequence with the words around a window; 0 if that isn't enough."""
        passage = self.m["words"][p]
        n = len(passage)
        low, high = max(0, start - n), min(len(ids), start + width + n)
        around = ids[low:high]
        times = self.times[p]
        # no more of the passage than the words that stand here can be in the subsequence
        if sum(map(times.__getitem__, times.keys() & set(around.tolist()))) < PARAPHRASED * n:
            return 0.0
        reach, best = n + n // 4 + 2, 0.0
        # the passage's own pairs must weigh enough, whatever other passages made the window worth a look
        if self._held(around, p) < PAIRS * self.weights[p] or common_subsequence(passage, around.tolist()) < PARAPHRASED * n:
            return 0.0
        for i in range(0, max(1, len(around) - reach + max(1, n // 8)), max(1, n // 8)):
            piece = around[i : i + reach].tolist()
            share = common_subsequence(passage, piece) / n
            if share > best:
                answer = passage[-ANSWER_WORDS:]
                if share >= COPIED or (share >= PARAPHRASED and common_subsequence(answer, piece) >= ANSWERED * len(answer)):
                    best = share
            if best >= 1:
                break
        return best


def search_base(docs: DataFrame, items: DataFrame, text_col: str) -> dict | None:
    """Terms of the whole benchmark, their idf over all of docs, and the latent space; None if no item has a word.

    The driver and each task hold a row of RANK numbers a term: bounded by the benchmark's vocabulary, not by the corpus.
    """
    spark = docs.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in strings(b.column(0)) for w in words_in(t)}), pa.string())], names=["term"])

    terms = sorted(r.term for r in items.select("text").mapInArrow(words, "term string").distinct().collect())
    if not terms:
        return None
    df, n = document_counts(docs, terms, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    latent = randomised_svd(items.select("text").repartition(parts(spark)), terms, idf)
    return {"terms": terms, "idf": idf, "latent": latent}


def search_blocks(items: DataFrame, base: dict, size: int) -> Iterator[dict]:
    """The passages in blocks of about `size`, dealt by hash, so that a long item's passages go to many: (rows, item: place
    in names, words, names)."""
    schema = "id long, words array<string>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                ps = passages_of(text)
                for k in range(0, len(ps), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(ps[k : k + 256]), pa.int64()), pa.array(ps[k : k + 256], pa.list_(pa.string()))], names=["id", "words"])

    passages = items.select("id", "text").mapInArrow(cut, schema)
    passages = materialize(passages, "passages")
    blocks = max(1, -(-passages.count() // size))
    number = {t: i for i, t in enumerate(base["terms"])}
    for k in range(blocks):
        some = passages if blocks == 1 else passages.where(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)) == k)
        got = some.orderBy("id", "words").collect()
        names = sorted({r.id for r in got}, key=lambda i: (i is None, i))
        place = {i: n for n, i in enumerate(names)}
        words = [np.array([number[w] for w in r.words], np.int32) for r in got]
        folded = np.zeros((len(got), base["latent"].shape[1]), np.float32)
        for i, w in enumerate(words):
            ids, weight = tf_idf(w, base["idf"])
            folded[i] = weight @ base["latent"][ids]
        folded /= np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-9)
        yield {"rows": folded, "item": np.array([place[r.id] for r in got], np.int64), "words": [w.tolist() for w in words], "names": names}


def _searches(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, text_col: str, size: int):
    """(base, block), both broadcast, for each block of passages."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    base = search_base(docs, items, text_col)
    if base is not None:
        sc = docs.sparkSession.sparkContext
        shared = sc.broadcast(base)
        for block in search_blocks(items, base, size):
            yield shared, sc.broadcast(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_PASSAGES) -> DataFrame:
    """A row for each document and benchmark item whose passage it holds: id, item_id, overlap (share of the passage in
    the common subsequence) and cosine. Clean documents have no row.

    Defined cases: null and empty texts hold nothing; null items and items without a word are not searched for; items of
    fewer than LEAST words are found where they stand word for word, those of fewer than INSIDE words as a line of their
    own; in scripts without spaces each letter is a word; equal rows each give their rows; null ids pass through; other
    columns are ignored; an empty table gives an empty result. Callers on a cluster run skein.session.ship first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = "id long, row long, item long, overlap double, cosine double"
    found = []
    for base, shared in _searches(docs, benchmark, item_col, item_text_col, text_col, block):

        def run(batches: Iterator[pa.RecordBatch], base=base, shared=shared) -> Iterator[pa.RecordBatch]:
            search, names = Searcher(base.value, shared.value), shared.value["names"]
            for b in batches:
                got = [(d, r, names[i], share, cos) for d, r, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strings(b.column(1)), strict=True) for i, share, cos in search(text)]
                cols = zip(*got, strict=True) if got else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["id", "row", "item", "overlap", "cosine"])

        found.append(rows.mapInArrow(run, schema))
    if len(found) > 1:  # an item's passages may be in several blocks; each pass is written, so one block is held at a time
        found = [materialize(f, "found") for f in found]
    out = found[0] if found else spark.createDataFrame([], schema)
    for f in found[1:]:
        out = out.union(f)
    if len(found) > 1:
        best = F.max(F.struct("overlap", "cosine")).alias("best")
        out = out.groupBy("id", "row", "item").agg(best).select("id", "item", "best.overlap", "best.cosine")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "overlap", "cosine")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_PASSAGES) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, with docs' own columns, without a shuffle. Each block of
    passages is a pass over what the one before has kept."""
    out, passes = docs, 0
    for base, shared in _searches(docs, benchmark, item_col, item_text_col, text_col, block):

        def run(batches: Iterator[pa.RecordBatch], base=base, shared=shared) -> Iterator[pa.RecordBatch]:
            search = Searcher(base.value, shared.value)
            for b in (part.slice(i, 1024) for part in batches for i in range(0, part.num_rows, 1024)):
                mask = pa.array([not search(x) for x in strings(b.column(b.schema.names.index("__text")))], pa.bool_())
                yield b.drop_columns(["__text"]).filter(mask)
            del search
            trim()

        if passes:
            out = materialize(out, "kept")
        out = out.withColumn("__text", F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
        passes += 1
    return out


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    from skein.session import table

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
