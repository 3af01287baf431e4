"""Substring deduplication by paragraph MinHash banding.

Paragraphs are the lines of a document of at least LEAST words. Their five-word shingles are MinHashed and banded for a
high recall at a Jaccard similarity of 0.8; colliding paragraphs are joined and verified by their exact Jaccard
similarity, and clustered by connected components. A passage that stands in the middle of other text is no line of its
own, so windows of WINDOW words that start at content-defined places are matched exactly as well, and those that overlap
are merged to passages. Of each component the occurrence in the document with the smallest id stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Forest, components, materialize, parts, strings

SHINGLE, SIMILAR = 5, 0.8
#: Bands of ROWS MinHash values: at a similarity of 0.8 a pair collides with probability 1 - (1 - 0.8**3)**10 = 0.9992.
BANDS, ROWS = 10, 3
#: Words of a repeated paragraph, at least; a similar one may have a fifth less.
LEAST = 50
#: Words of a window, and reach of the comparison that makes a place a window's start (one word in about 2 REACH + 1).
WINDOW, REACH = 20, 6
#: Members of a block of a bucket; larger buckets are compared block by block. Blocks grow with a bucket up to MOST.
BLOCK, MOST = 128, 2048
#: Words of a block, about.
BLOCK_WORDS = 1 << 19

_MUL = np.random.default_rng(17).integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(18).integers(1, 1 << 63, BANDS * ROWS, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_NULL_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs_of(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for i in range(n):
        out = out * _P + w[i : len(w) - n + 1 + i]
    return _mix(out)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(w: np.ndarray) -> np.ndarray:
    """Places whose hash of three words is below all others within REACH; they depend on the near words alone."""
    g = _runs_of(w, 3)
    n = len(g)
    padded = np.full(n + 2 * REACH, np.iinfo(np.uint64).max, np.uint64)
    padded[REACH : REACH + n] = g
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for d in range(2 * REACH + 1):
        if d != REACH:
            np.minimum(low, padded[d : d + n], out=low)
    return np.flatnonzero(g < low)


def shingles(words: list[bytes]) -> set[bytes]:
    if len(words) < SHINGLE:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def band_keys(w: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Band keys (spans x BANDS) of paragraphs given as ranges of words, each of at least SHINGLE words."""
    s = _runs_of(w, SHINGLE)
    at = np.concatenate([s[a : b - SHINGLE + 1] for a, b in spans])
    starts = np.concatenate(([0], np.cumsum([b - a - SHINGLE + 1 for a, b in spans])[:-1]))
    # shingle hashes are mixed already, so a multiplication and an addition order them anew for each value
    low = np.stack([np.minimum.reduceat(at * m + p, starts) for m, p in zip(_MUL, _ADD, strict=True)], axis=1).reshape(len(spans), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * _P + np.uint64(1)
    for r in range(ROWS):
        key = _mix(key ^ low[:, :, r]) * _P
    return key


def _scan(least: int):
    """Rows (id, row, text) -> a row for each paragraph (kind 0, with bands and words) and each window (kind 1)."""
    names = ["kind", "hash", "id", "row", "start", "n", "bands", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                kinds, hashes, ids, rows, starts, ns, bands, texts = [], [], [], [], [], [], [], []
                for doc, row, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strings(some.column(2)), strict=True):
                    words: list[bytes] = []
                    spans = []
                    for line in text.split("\n"):
                        a = len(words)
                        words += words_of(line)
                        if len(words) - a >= max(SHINGLE, int(SIMILAR * least)):
                            spans.append((a, len(words)))
                    w = word_hashes(words)
                    if spans:
                        joined = [b" ".join(words[a:e]) for a, e in spans]
                        kinds.append(np.zeros(len(spans), np.int32))
                        hashes.append(np.array([xxhash.xxh3_64_intdigest(x, 1) for x in joined], np.uint64))
                        starts.append(np.array([a for a, _ in spans]))
                        ns.append(np.array([e - a for a, e in spans]))
                        bands += band_keys(w, spans).view(np.int64).tolist()
                        texts += joined
                    at = anchors(w)
                    at = at[at <= len(w) - WINDOW]
                    if len(at):
                        kinds.append(np.ones(len(at), np.int32))
                        windows = np.zeros(len(at), np.uint64)
                        for k in range(WINDOW):
                            windows = windows * _P + w[at + k]
                        hashes.append(_mix(windows))
                        starts.append(at)
                        ns.append(np.full(len(at), WINDOW))
                        bands += [None] * len(at)
                        texts += [None] * len(at)
                    n = len(spans) + len(at)
                    ids.append(np.full(n, _NULL_ID if doc is None else doc, np.int64))
                    rows.append(np.full(n, row, np.int64))
                if kinds:
                    cat = lambda x, t: pa.array(np.concatenate(x).astype(t))
                    out = [cat(kinds, np.int32), pa.array(np.concatenate(hashes).view(np.int64)), cat(ids, np.int64), cat(rows, np.int64), cat(starts, np.int32), cat(ns, np.int32), pa.array(bands, pa.list_(pa.int64())), pa.array(texts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def similar_links(texts: list[bytes], nodes: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links (exact Jaccard of SIMILAR or more) among paragraphs; a pair already connected needs
    no check."""
    sets: dict[int, set] = {}
    forest = Forest()
    out = []
    order = sorted(range(len(texts)), key=lambda i: nodes[i])
    for i in order:
        sets[i] = shingles(texts[i].split(b" "))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small < SIMILAR * large or forest.find(nodes[i]) == forest.find(nodes[j]):
                continue
            if jaccard(sets[i], sets[j]) >= SIMILAR:
                forest.join(nodes[i], nodes[j])
                out.append((nodes[i], nodes[j]))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, hash, text, group) sorted by cell -> links; one cell is held at a time, of two blocks at most."""
    now, texts, nodes = None, [], []

    def done() -> pa.RecordBatch:
        got = similar_links(texts, nodes)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

    for b in batches:
        for cell, node, text, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if cell != now:
                if len(nodes) > 1:
                    yield done()
                now, texts, nodes = cell, [], []
            texts.append(text)
            nodes.append(node)
    if len(nodes) > 1:
        yield done()


def shared_buckets(kinds: DataFrame) -> DataFrame:
    """(bucket, place, hash, key, size) of the bands that several texts have, written out; kinds: (hash, key, size, bands), a
    hash once, size in words. Joins name their form, so that a corpus of any size is moved in the same way."""
    keyed = kinds.select("hash", "key", "size", F.posexplode("bands").alias("place", "band"))
    buckets = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("number"), F.min("place").alias("first"), F.sum(F.xxhash64("hash").cast("decimal(38,0)")).alias("members")).where("number > 1")
    # the same members often meet in several bands; one of these buckets is enough
    buckets = buckets.groupBy("number", "members").agg(F.min(F.struct("first", "band")).alias("b")).select(F.col("b.band").alias("bucket"))
    return materialize(keyed.join(buckets.hint("merge"), F.col("band") == F.col("bucket")).select("bucket", "place", "hash", "key", "size"), "held")


def labelled(held: DataFrame, joined: DataFrame | None) -> DataFrame:
    """held with `group`, the component in joined (node, component) or the hash itself."""
    if joined is None:
        return held.withColumn("group", F.col("hash"))
    known = joined.select(F.col("node").alias("known"), "component")
    return held.join(known, F.col("hash") == F.col("known"), "left").withColumn("group", F.coalesce("component", "hash")).drop("known", "component")


def banded_links(held: DataFrame, texts: DataFrame, cells: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], joined: DataFrame | None = None, shares: int = 8) -> DataFrame:
    """Links (a, b) between hashes of similar texts, as `cells` finds them among those that share a bucket of held, in all
    pairs that joined doesn't connect already. A bucket is split to `shares` blocks, and to more where a block would hold
    over MOST texts; each of its texts goes to about as many cells.

    texts: (of, text) by key. The members of a bucket that are of its first member's component are its base, which needs
    no comparison within itself; the others, the strangers, are compared with the base and with each other, block by
    block. cells gets rows (cell, hash, text, group).
    """
    n = parts(held.sparkSession)
    rows = labelled(held, joined)
    buckets = rows.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min_by("group", "hash").alias("base")).where("low < high").select(F.col("bucket").alias("of_bucket"), "base")
    rows = materialize(rows.join(buckets, F.col("bucket") == F.col("of_bucket")).select("bucket", "hash", "key", "size", "group", (F.col("group") != F.col("base")).alias("stranger")), "members")
    sizes = rows.groupBy("bucket", "stranger").agg(F.count(F.lit(1)).alias("number"), F.sum("size").alias("words"))
    # a block is bounded in texts and in words
    few = F.least(F.lit(MOST), F.greatest(F.lit(BLOCK), F.col("number") / shares))
    blocks = F.greatest(F.ceil(F.col("number") / few), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    of = lambda stranger: F.max(F.when(F.col("stranger") == stranger, blocks))
    sizes = sizes.groupBy(F.col("bucket").alias("of_bucket")).agg(of(True).alias("sb"), of(False).alias("bb"))
    rows = rows.join(sizes, F.col("bucket") == F.col("of_bucket"))
    mine = F.pmod(F.xxhash64("hash", F.lit(1)), F.when(F.col("stranger"), F.col("sb")).otherwise(F.col("bb"))).cast("int")
    rows = rows.withColumn("mine", mine)
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_base = F.when(F.col("stranger"), F.transform(upto("bb"), lambda j: F.xxhash64("bucket", F.lit("b"), "mine", j))).otherwise(F.transform(upto("sb"), lambda i: F.xxhash64("bucket", F.lit("b"), i, "mine")))
    # strangers of one block meet in its cells with the base already
    among = F.when(F.col("stranger") & (F.col("sb") > 1), F.transform(upto("sb"), lambda i: F.xxhash64("bucket", F.lit("s"), F.least(i, F.col("mine")), F.greatest(i, F.col("mine"))))).otherwise(F.array().cast("array<bigint>"))
    dealt = rows.select("hash", "key", "group", "stranger", F.explode(F.concat(with_base, among)).alias("cell"))
    dealt = materialize(dealt.groupBy("cell", "hash", "key", "group").agg(F.max("stranger").alias("stranger")), "cells")
    rows = dealt.join(texts.hint("merge"), F.col("key") == F.col("of")).select("cell", "hash", "text", "group", "stranger")
    return rows.repartition(n, "cell").sortWithinPartitions("cell", F.desc("stranger")).select("cell", "hash", "text", "group").mapInArrow(cells, "a long, b long")


def paragraph_links(paragraphs: DataFrame) -> DataFrame:
    """Links (a, b) between hashes of similar paragraphs of `paragraphs` (hash, n, bands, text; equal hashes may repeat)."""
    kinds = materialize(paragraphs.select("hash", F.col("hash").alias("key"), F.col("n").alias("size"), "bands").dropDuplicates(["hash"]), "kinds")

    held = shared_buckets(kinds)
    wanted = held.select(F.col("hash").alias("wanted")).distinct()
    texts = paragraphs.select(F.col("hash").alias("of"), "text").join(wanted, F.col("of") == F.col("wanted"), "left_semi").dropDuplicates(["of"])
    return banded_links(held, materialize(texts, "texts"), _cells)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, start, n, hash) sorted by row and start -> the same with the start and length of their passage."""
    held: list[tuple] = []
    reach = -1

    def done() -> pa.RecordBatch:
        row, doc, start = held[0][:3]
        end = max(s + n for _, _, s, n, _ in held)
        k = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([row] * k, pa.int64()), pa.array([doc] * k, pa.int64()), pa.array([start] * k, pa.int32()), pa.array([end - start] * k, pa.int32()), pa.array([h for *_, h in held], pa.int64())], names=["row", "id", "start", "n", "hash"]
        )

    ready: list[pa.RecordBatch] = []
    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and (x[0] != held[0][0] or x[2] > reach):
                ready.append(done())
                held = []
                if len(ready) >= 1024:
                    yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                    ready = []
            reach = max(reach, x[2] + x[3]) if held else x[2] + x[3]
            held.append(x)
    if held:
        ready.append(done())
    if ready:
        yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """A row for each passage that repeats across documents: id, kind (paragraph or passage), start_word, n_words (words
    that are surely repeated), component_id (the smallest id whose document holds a passage of the component) and keep
    (whether this is the document whose copy stays).

    A paragraph is a line of at least four fifths of `least` words with a line of another document at a Jaccard
    similarity of SIMILAR or more on five-word shingles, one of the component having `least` words or more; a passage is
    made of overlapping windows of WINDOW words, each of which some other document holds word for word (A-Z in either
    case), so a repeat of `least` words is found whatever stands around it, with a probability over 0.99 that grows with
    its length. Documents without repeats have no row.

    Defined cases: null and empty texts have no passages; rows with equal ids are one document, so a text that repeats
    under one id alone is no repeat; rows with null ids are one document together, with a null id, and give no component
    its id unless alone in it; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = "kind int, hash long, id long, row long, start int, n int, bands array<long>, text binary"
    found = materialize(rows.mapInArrow(_scan(least), schema), "passages")
    null_id = F.lit(_NULL_ID)

    def spread(df: DataFrame, key: str) -> DataFrame:
        """The keys that stand in two documents at least."""
        return df.groupBy(key).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.col(key).alias("spread"))

    # windows: held by two documents, merged to passages
    windows = found.where("kind = 1").select("row", "id", "start", "n", "hash")
    shared = materialize(spread(windows, "hash"), "shared")
    hits = windows.join(shared, F.col("hash") == F.col("spread"), "left_semi").dropDuplicates(["row", "start"])
    merged = hits.repartition(parts(docs.sparkSession), "row").sortWithinPartitions("row", "start").select("row", "id", "start", "n", "hash")
    merged = materialize(merged.mapInArrow(_merge, "row long, id long, start int, n int, hash long"), "merged")
    node = F.xxhash64("row", "start", F.lit("passage"))
    window_edges = merged.select(node.alias("a"), F.col("hash").alias("b"))
    passages = merged.select(node.alias("node"), "id", "start", "n").distinct().withColumn("kind", F.lit("passage"))

    # paragraphs: similar to another, or the same in two documents
    lines = found.where("kind = 0")
    links = materialize(paragraph_links(lines.select("hash", "n", "bands", "text")), "links")
    paragraphs = lines.select(F.col("hash").alias("node"), "id", "start", "n").withColumn("kind", F.lit("paragraph"))

    comps = materialize(components(window_edges.union(links)), "comps").withColumnRenamed("node", "member")
    all_found = passages.unionByName(paragraphs)
    known = all_found.join(comps, F.col("node") == F.col("member"), "left").withColumn("component", F.coalesce("component", "node")).drop("member", "node")
    known = materialize(known, "known")
    real = F.when(F.col("id") != null_id, F.col("id"))
    longest = F.max(F.when(F.col("kind") == "passage", F.lit(least)).otherwise(F.col("n")))
    groups = known.groupBy("component").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(real).alias("head"), longest.alias("longest"))
    groups = groups.where("lo < hi").where(F.col("longest") >= least).select(F.col("component").alias("of"), "head")
    groups = materialize(groups, "groups")
    out = known.join(groups, F.col("component") == F.col("of")).withColumn("id", real)
    keep = F.coalesce(F.col("id") == F.col("head"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "kind", F.col("start").alias("start_word"), F.col("n").alias("n_words"), F.col("head").alias("component_id"), keep.alias("keep"))


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    from skein.session import table

    return repeated_passages(table(spark, sf_dir, "documents"))
