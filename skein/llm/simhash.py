"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Fingerprints link when they differ in at most RADIUS bits. Each of the 64 bit places is given a vector of RADIUS + 1
bits; table v (v a non-zero vector) keeps the places whose vector has an odd inner product with v. The vectors of at
most RADIUS differing places span less than the whole space, so some v is orthogonal to all of them and its table keeps
none of the differing places: every pair within the radius collides there for certain (Pagh, "CoveringLSH").

keep_one, the pipeline's stage, has a rule of its own: texts link from a Jaccard similarity of SIMILAR on five-word
shingles. It fingerprints the sets of these shingles and takes what the same covering search connects as candidates, each
of which is measured. Texts at SIMILAR differ in up to a dozen bits and more, which no covering family of bearable size
reaches, so MinHash bands add the candidates beyond RADIUS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import components, drop_shared, materialize, parts, strings, trim
from skein.llm.substrings import SHINGLE, _mix, _runs_of, banded_links, labelled, shared_buckets, word_hashes, words_of

RADIUS = 3
BITS = 64
SEED = 42
#: Members of a bucket that are compared in one task; larger buckets are dealt out by a second family of masks.
BUCKET = 4096
#: keep_one: texts link if SIMILAR[0] / SIMILAR[1] of their shingles or more are common to both.
SIMILAR = 4, 5
#: Bands of ROWS MinHash values: a pair at 0.8 is missed with probability (1 - 0.8**4)**30 = 1.4e-7, a closer one with less.
BANDS, ROWS = 30, 4
#: Bands that are searched first: a pair at 0.9 is found there with probability 1 - (1 - 0.9**4)**6 = 0.998.
FIRST = 6
#: Members that are measured against one copy of a bucket's hub.
HUB = 4096

_MUL = np.random.default_rng(19).integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(20).integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def covering_masks(places: list[int], radius: int = RADIUS) -> list[int]:
    """The masks (as unsigned integers) of a covering family over the given bit places, dealt evenly to the vectors."""
    vectors = range(1, 2 ** (radius + 1))
    of = {p: vectors[i % len(vectors)] for i, p in enumerate(places)}
    return [sum(1 << p for p in places if (of[p] & v).bit_count() % 2) for v in vectors]


MASKS = covering_masks(list(range(BITS)))


def fine_masks(table: int) -> list[int]:
    """For the buckets of a table: its mask together with each mask of a covering family over the places it leaves out.

    At most 16 places stay free, so a bucket of these has 2**16 different fingerprints at most, however large the corpus.
    """
    free = [p for p in range(BITS) if not MASKS[table] >> p & 1]
    return [MASKS[table] | m for m in covering_masks(free)]


FINE = [m for t in range(len(MASKS)) for m in fine_masks(t)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text as an unsigned integer.

    A-Z are lower-cased, words are runs of anything but the six ASCII white spaces, shingles are `width` words joined by
    a space (all words if there are fewer), hashed by XXH64 with seed 42, repeats included. A bit is 1 if set in over
    half of the hashes. Null and texts without words give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        some = np.frombuffer(b"".join(hashes[i : i + 8192]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(x) for x in strings(b.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])
    trim()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_of(fps: np.ndarray, nodes: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one bucket, found by comparing all of them in blocks."""
    n, out = len(fps), []
    if n == 2:
        return [(int(nodes[0]), int(nodes[1]))] if int(np.bitwise_count(fps[0] ^ fps[1])) <= radius else []
    label = np.arange(n)
    for i in range(n - 1):  # everything linked to i that is not yet of its group joins it
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1
        for j in near[label[near] != label[i]]:
            if label[j] != label[i]:
                out.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return out


def _bucket_links(limit: int | None):
    """For rows (table, key, fp, node) sorted by table and key: rows (a, b, null) for links and, for buckets beyond the
    limit, rows (fp, node, table), which are left to the finer masks. Memory is bounded by the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_k, held_f, held_n = (np.empty(0, np.int64) for _ in range(4))
        flooded: tuple[int, int] | None = None

        def work(t, k, f, n, last: bool):
            nonlocal held_t, held_k, held_f, held_n, flooded
            held_t, held_k, held_f, held_n = t, k, f, n
            if not len(t):
                return [], []
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts = np.concatenate(([0], cut))
            ends = np.append(cut, len(t))
            links, over = [], []
            upto = len(starts) if last else len(starts) - 1
            sizes = ends - starts
            for s in np.flatnonzero((sizes > 1) | (starts == 0)):
                a, e = starts[s], ends[s]
                known = flooded == (int(t[a]), int(k[a]))
                whole = s < upto
                if known or (limit is not None and e - a > limit):
                    flooded = (int(t[a]), int(k[a]))
                    over.append((f[a:e], n[a:e], t[a:e]))
                elif whole and e - a > 1:
                    links += links_of(f[a:e].view(np.uint64), n[a:e])
            if last:
                return links, over
            a = starts[-1]
            if flooded == (int(t[a]), int(k[a])):
                a = len(t)  # handed on already
            held_t, held_k, held_f, held_n = t[a:], k[a:], f[a:], n[a:]
            return links, over

        def batch(links, over) -> pa.RecordBatch:
            a = [np.array([x for x, _ in links], np.int64), *(f for f, _, _ in over)]
            b = [np.array([y for _, y in links], np.int64), *(n for _, n, _ in over)]
            none = pa.nulls(len(links), pa.int32())
            t = pa.array(np.concatenate([x for *_, x in over]).astype(np.int32)) if over else pa.array([], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.concat_arrays([none, t])], names=["a", "b", "tab"])

        for x in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in x.columns]
            links, over = work(*(np.concatenate(p) for p in zip((held_t, held_k, held_f, held_n), new, strict=True)), last=False)
            if links or over:
                yield batch(links, over)
        links, over = work(held_t, held_k, held_f, held_n, last=True)
        if links or over:
            yield batch(links, over)

    return run


def _bucketed(df: DataFrame, limit: int | None) -> DataFrame:
    n = parts(df.sparkSession)
    rows = df.repartition(n, "tab", "key").sortWithinPartitions("tab", "key").select(F.col("tab").cast("long"), "key", "fp", "node")
    return rows.mapInArrow(_bucket_links(limit), "a long, b long, tab int")


def hamming_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) with the same components as all pairs of `nodes` (fp, node; fp distinct) within RADIUS bits."""
    tables = F.posexplode(F.array(*[F.lit(_signed(m)) for m in MASKS])).alias("tab", "mask")
    rows = nodes.select("fp", "node", tables).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    first = materialize(_bucketed(rows.select("tab", "key", "fp", "node"), bucket), "links")
    over = first.where("tab is not null").select(F.col("a").alias("fp"), F.col("b").alias("node"), "tab")
    fine = F.array(*[F.array(*[F.lit(_signed(m)) for m in fine_masks(t)]) for t in range(len(MASKS))])
    split = over.select("fp", "node", "tab", F.posexplode(fine[F.col("tab")]).alias("sub", "mask"))
    split = split.select((F.col("tab") * len(MASKS) + F.col("sub")).alias("tab"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node")
    links = first.where("tab is null").select("a", "b")
    if not over.isEmpty():
        links = links.union(_bucketed(split, None).select("a", "b"))
    return links


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, its fingerprint (16 hexadecimal digits) and component_id, the smallest id that
    links of at most RADIUS differing bits can reach, itself included.

    Defined cases: null and empty texts have fingerprint zero and link like any other; a text of one or two words is one
    shingle; equal rows each give a row; a null id is never a component's id if any member has one, and gives null
    otherwise; other columns are ignored, whatever their names; an empty table gives an empty result.
    Equal fingerprints are collapsed before the search, so groups of copies of any size cost one entry.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(texts.mapInArrow(_fingerprints, "id long, fp long"), "prints")
    # classes without any id get a stand-in above all ids in use
    stand_in = F.lit(1 << 62) + F.col("fp").bitwiseAND(F.lit((1 << 62) - 1))
    classes = prints.groupBy("fp").agg(F.min("id").alias("low")).select("fp", F.coalesce("low", stand_in).alias("node"))
    classes = materialize(classes, "classes")
    found = components(hamming_links(classes))
    labels = classes.join(found, "node", "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "node").alias("component"))
    out = prints.join(labels, prints["fp"] == labels["class_fp"], "left")
    comp = F.when(F.col("component") < F.lit(1 << 62), F.col("component"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), comp.alias("component_id"))


def text_shingles(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, sorted; a shorter text is one shingle."""
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    return np.unique(_runs_of(word_hashes(words), SHINGLE))


def text_bands(shingles: np.ndarray) -> np.ndarray:
    """The BANDS keys of a text."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[None, i : i + 1024] * _MUL + _ADD).min(1), out=low)
    low = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
    return key


def text_print(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed integer: a bit is 1 if set in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(shingles), 8192):
        counts += np.unpackbits(shingles[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles)).view(np.int64)[0])


def _hash_of(words: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(words, 1)
    return x - (1 << 64) if x >> 63 else x


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> (id, hash of the words, their number, bands, fingerprint); texts without these are too short to
    be like any other."""
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            b = whole.slice(i, 256)
            hashes, sizes, bands, prints = [], [], [], []
            for x in strings(b.column(1)):
                words = words_of(x)
                hashes.append(_hash_of(b" ".join(words)))
                sizes.append(len(words))
                own = text_shingles(words) if len(words) >= SHINGLE else None
                bands.append(None if own is None else text_bands(own).view(np.int64))
                prints.append(None if own is None else text_print(own))
            columns = [b.column(0), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "hash", "size", "bands", "fp"])
    trim()


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is the text -> the same with the hash of its words in the last column's place."""
    for whole in batches:
        for i in range(0, whole.num_rows, 1024):
            b = whole.slice(i, 1024)
            hashes = pa.array([_hash_of(b" ".join(words_of(x))) for x in strings(b.column(b.num_columns - 1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], hashes], schema=pa.schema([*list(b.schema)[:-1], pa.field("__hash", pa.int64())]))
    trim()


def similar_texts(sets: list[np.ndarray], nodes: list[int], groups: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links of SIMILAR or more among texts, given as sets of shingles; a text is measured against
    all later ones, unless all of those that are near enough in size are connected with it already. Texts of one group
    are connected from the start."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
    at = at.astype(np.int32)
    mark = np.zeros(len(vocabulary), bool)
    label = np.unique(np.array(groups), return_inverse=True)[1]
    part, of = SIMILAR
    out = []
    for i in range(len(sets) - 1):
        size = sizes[i + 1 :]
        open_ = (label[i + 1 :] != label[i]) & (of * np.minimum(size, sizes[i]) >= part * np.maximum(size, sizes[i]))
        if not open_.any():
            continue
        first = i + 1 + int(open_.argmax())
        own = at[starts[i] : starts[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[at[starts[first] :]].astype(np.int32), starts[first:-1] - starts[first])
        mark[own] = False
        for j in np.flatnonzero(open_[first - i - 1 :] & (of * both >= part * (sizes[first:] + sizes[i] - both))) + first:
            if label[j] != label[i]:
                out.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return out


def _text_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, hash, text, group) sorted by cell -> links; one cell is held at a time, which banded_links bounds. A row
    whose text has another hash is another text of a repeated id and is left out."""
    now, sets, nodes, groups = None, [], [], []

    def done() -> pa.RecordBatch:
        got = similar_texts(sets, nodes, groups)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            for cell, node, text, group in zip(*(c.to_pylist() for c in whole.slice(i, 256).columns), strict=True):
                if cell != now:
                    if len(set(groups)) > 1:
                        yield done()
                    now, sets, nodes, groups = cell, [], [], []
                words = words_of(text)
                if _hash_of(b" ".join(words)) == node:
                    sets.append(text_shingles(words))
                    nodes.append(node)
                    groups.append(group)
    if len(set(groups)) > 1:
        yield done()
    del sets
    trim()


def _star_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, role, hash, text) sorted by cell and role, a cell's hub (role 0) first -> links of the hub with those that
    are like it; one hub is held at a time."""
    now, hub, hub_node = None, None, None
    part, of = SIMILAR
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            links = []
            for cell, role, node, text in zip(*(c.to_pylist() for c in whole.slice(i, 256).columns), strict=True):
                if cell != now:
                    now, hub = cell, None
                words = words_of(text)
                if _hash_of(b" ".join(words)) != node:
                    continue
                own = text_shingles(words)
                if role == 0:
                    hub, hub_node = own, node
                elif hub is not None and of * min(len(own), len(hub)) >= part * max(len(own), len(hub)):
                    both = int(np.isin(own, hub, assume_unique=True).sum())
                    if of * both >= part * (len(own) + len(hub) - both):
                        links.append((hub_node, node))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])
    del hub
    trim()


def star_links(held: DataFrame, texts: DataFrame, seed: int, joined: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of each bucket's hub, a member chosen by hash, with its other members that joined doesn't connect with
    it. The work is linear in held; a hub of many members is copied, each copy for HUB of them."""
    n = parts(held.sparkSession)
    rows = labelled(held.select("bucket", "hash", "key"), joined)
    first = F.min(F.struct(F.xxhash64("hash", F.lit(seed)).alias("order"), "hash", "key", "group")).alias("hub")
    hubs = rows.groupBy("bucket").agg(first, F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    hubs = hubs.select(F.col("bucket").alias("of_bucket"), F.col("hub.hash").alias("hub"), F.col("hub.key").alias("hub_key"), F.col("hub.group").alias("hub_group"))
    pairs = rows.join(hubs, F.col("bucket") == F.col("of_bucket")).where(F.col("group") != F.col("hub_group")).select("hub", "hub_key", "hash", "key").distinct()
    pairs = materialize(pairs, "pairs")
    copies = pairs.groupBy(F.col("hub").alias("of_hub"), "hub_key").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("copies"))
    members = pairs.drop("hub_key").join(copies.drop("hub_key"), F.col("hub") == F.col("of_hub"))
    members = members.select(F.xxhash64("hub", F.pmod(F.xxhash64("hash", F.lit(2)), F.col("copies")).cast("int")).alias("cell"), F.lit(1).alias("role"), "hash", "key")
    own = copies.select(F.col("of_hub").alias("hash"), F.col("hub_key").alias("key"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    own = own.select(F.xxhash64("hash", "copy").alias("cell"), F.lit(0).alias("role"), "hash", "key")
    cells = materialize(members.unionByName(own), "stars")
    rows = cells.join(texts.hint("merge"), F.col("key") == F.col("of")).select("cell", "role", "hash", "text")
    return rows.repartition(n, "cell").sortWithinPartitions("cell", "role").mapInArrow(_star_cells, "a long, b long")


def print_buckets(kinds: DataFrame) -> DataFrame:
    """(bucket, place, hash, key, size) of the texts that links of at most RADIUS differing bits connect with another, a
    component being a bucket; kinds: (hash, key, size, fp), a hash once."""
    prints = materialize(kinds.select("fp", F.col("fp").alias("node")).distinct(), "prints")
    found = materialize(components(hamming_links(prints)), "components").withColumnRenamed("node", "of_fp")
    rows = kinds.select("hash", "key", "size", "fp").join(found.hint("merge"), F.col("fp") == F.col("of_fp"), "left")
    return shared_buckets(rows.select("hash", "key", "size", F.array(F.coalesce("component", "fp")).alias("bands")))


def similar_components(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, component) of the texts (id, text) in docs that are like another, nodes being the hashes in sketches.

    Candidates are the texts that the covering search connects and, for those that differ in more than RADIUS bits, the
    texts of a MinHash bucket. First the members of each bucket are measured against one of them, in three rounds, those
    of the covering search before any of MinHash; that connects large groups in linear work. What is left in a bucket
    unconnected is compared in all pairs, so no link between two components is missed.
    """
    firsts = [F.min(c).alias(c) for c in ("size", "bands", "fp")]
    kinds = sketches.where("bands is not null").groupBy("hash").agg(F.min("id").alias("key"), *firsts)
    near, banded = print_buckets(kinds), shared_buckets(kinds)
    held = near.unionByName(banded)
    wanted = held.select(F.col("key").alias("wanted")).distinct()
    texts = docs.select(F.col("id").alias("of"), F.coalesce("text", F.lit("")).alias("text")).join(wanted.hint("merge"), F.col("of") == F.col("wanted"), "left_semi")
    texts = materialize(texts, "texts")
    links = materialize(star_links(near, texts, 0), "links")
    found = materialize(components(links), "components")

    def also(more: DataFrame) -> DataFrame:
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return materialize(components(stars.union(more)), "components")

    found = also(star_links(banded.where(F.col("place") < FIRST), texts, 0, found))
    found = also(star_links(held, texts, 1, found))
    found = also(banded_links(held, texts, _text_cells, found, 1))
    drop_shared(near, banded, texts, links)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one of each group of near copies: the row with the smallest id stays.

    Groups are the components of the pairs whose sets of five-word shingles (A-Z lower-cased) have a Jaccard similarity of
    0.8 or more. A text of fewer than five words is one shingle, and texts without words (null, empty, white space) are
    copies of each other. Rows are told apart by id and words, not by id alone: rows that share an id but are not alike
    all stay; of rows with the same id and words one stays, whichever. Rows with a null id stay as they are and link
    nothing. Columns are those of docs, which may have any other names but __hash. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    sketches = materialize(rows.mapInArrow(_sketches, "id long, hash long, size int, bands array<long>, fp long"), "sketches")
    found = similar_components(rows, sketches)
    # copies of any number are one entry here
    classes = sketches.groupBy("hash").agg(F.min("id").alias("low"))
    groups = classes.join(found, F.col("hash") == F.col("node"), "left").groupBy(F.coalesce("component", "hash").alias("component"))
    heads = groups.agg(F.min(F.struct("low", "hash")).alias("head")).select("head.low", "head.hash")
    heads = materialize(heads, "heads")
    ids = sketches.select("id", "hash").groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n"))
    ids = materialize(ids, "ids")
    # what goes is less than what stays
    gone = materialize(ids.join(heads, (F.col("id") == F.col("low")) & (ids["hash"] == heads["hash"]), "left_anti").select(F.col("id").alias("__id"), F.col("hash").alias("__of")), "gone")
    more = materialize(ids.where("n > 1").select(F.col("id").alias("__id"), F.col("hash").alias("__of")), "repeated")
    schema = T.StructType([*docs.schema.fields, T.StructField("__hash", T.LongType())])
    hashed = docs.where(F.col(id_col).isNotNull()).withColumn("__hash", F.col(text_col).cast("string")).mapInArrow(_with_hash, schema)
    same = (F.col(id_col).cast("long") == F.col("__id")) & (F.col("__hash") == F.col("__of"))
    kept = hashed.join(gone.hint("merge"), same, "left_anti")
    if not more.isEmpty():
        kept = kept.join(more, same, "left_anti").unionByName(kept.join(more, same, "left_semi").dropDuplicates([id_col, "__hash"]))
    return kept.drop("__hash").unionByName(docs.where(F.col(id_col).isNull()))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    from skein.session import table

    return simhash_components(table(spark, sf_dir, "documents"))
