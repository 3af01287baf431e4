"""Approximate nearest neighbours by cosine: a forest of random-projection trees with a shared priority queue.

Trees are grown on a bounded sample; each node splits by the direction between two centres that start from random rows,
at the median. Every row of the table is put in one leaf of each tree. A query walks all trees through one priority
queue, ordered by the sum of squared distances to the planes it has crossed, until the leaves it has met hold its budget.
The budget is not set by hand: queries from the sample, whose neighbours in the sample are known by brute force, say how
far the queue must be followed to meet a share RECALL of them. On vectors with structure that is a small part of the
rows, on vectors without any a large one.

Rows are sent to the leaves they are in, queries to the leaves they have met, and only rows and queries that share a leaf
are multiplied; the best of them are reranked by their exact cosine in double precision. Leaves are packed to cells of
about CELL rows, and a leaf with more is dealt out to several, so no task holds more rows than that.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import drop_shared, materialize, parts

TREES, LEAF, SEED = 8, 32, 3
#: Rows that the trees are grown on, about; every row is indexed whatever its number.
SAMPLE = 20_000
#: Share of the sample's known neighbours that the budget must reach, and the number of queries that measure it.
RECALL, MEASURED = 0.95, 200
#: Rows of a cell, about, and queries compared with them at a time.
CELL, BATCH = 8192, 512
#: Queries that meet one copy of a cell; beyond it cells are copied, each copy for a part of the queries.
QUERIES = 1 << 20
EVERY = 50
#: Single precision is good to well under this.
SLACK = np.float32(2e-5)


def grow(x: np.ndarray, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """One tree over rows of length one: (planes, offsets, children, members of each leaf). Inner node i splits by planes[i]
    and offsets[i]; children are nodes, or leaves as -1 - leaf. Neighbouring leaves have neighbouring numbers."""
    rng = np.random.default_rng(seed)
    planes, offsets, children, members = [], [], [[0, 0]], []
    # an explicit stack: copies can't be split and end in one leaf, whatever their number; children[0] stands for the root
    todo = [(np.arange(len(x)), 0, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = None
        if len(rows) > leaf:
            some = x[rows if len(rows) <= 128 else rng.choice(rows, 128, replace=False)]
            centres = some[rng.permutation(len(some))[:2]].copy()
            for _ in range(4):
                near = (some @ centres.T).argmax(1)
                for k in (0, 1):
                    if (near == k).any():
                        centres[k] = some[near == k].mean(0)
            plane = centres[0] - centres[1]
            length = np.linalg.norm(plane)
            if length > 1e-6:
                plane = plane / length
                at = x[rows] @ plane
                cut = np.median(at)
                if (at > cut).any():
                    split = plane, cut, rows[at <= cut], rows[at > cut]
        if split is None:
            children[parent][side] = -1 - len(members)
            members.append(rows)
            continue
        planes.append(split[0])
        offsets.append(split[1])
        children.append([0, 0])
        node = len(planes)
        children[parent][side] = node
        todo += [(split[2], node, 0), (split[3], node, 1)]
    return np.array(planes, np.float32).reshape(-1, x.shape[1]), np.array(offsets, np.float32), np.array(children, np.int64), members


class Forest:
    """Arrays of all trees, with common numbers for nodes and leaves."""

    def __init__(self, grown: list[tuple]):
        self.planes = np.concatenate([g[0] for g in grown])
        self.offsets = np.concatenate([g[1] for g in grown])
        self.members = [m for g in grown for m in g[3]]
        self.sizes = np.array([len(m) for m in self.members])
        self.first_leaf = np.cumsum([0, *(len(g[3]) for g in grown)])
        children, self.roots, nodes = [], [], 0
        for (planes, _, kids, _), leaf in zip(grown, self.first_leaf, strict=False):
            moved = np.where(kids < 0, kids - leaf, kids - 1 + nodes)
            self.roots.append(int(moved[0, 0]))
            children.append(moved[1:])
            nodes += len(planes)
        self.children = np.concatenate(children)

    @classmethod
    def of(cls, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
        return cls([grow(sample, leaf, seed * 1000 + t) for t in range(trees)])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row (of length one) in every tree: rows x trees."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, np.int64)
            while len(live := np.flatnonzero(at >= 0)):
                node = at[live]
                right = np.einsum("ij,ij->i", x[live], self.planes[node]) > self.offsets[node]
                at[live] = self.children[node, right.astype(np.int64)]
            out[:, t] = -1 - at
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """All leaves in the order of the shared queue."""
        margin = (self.planes @ q - self.offsets).tolist() if len(self.planes) else []
        children = self.children.tolist() if not hasattr(self, "_kids") else self._kids
        self._kids = children
        queue = [(0.0, r) for r in self.roots]
        heapq.heapify(queue)
        while queue:
            cost, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[node]
                low, high = children[node]
                near, far = (high, low) if m > 0 else (low, high)
                heapq.heappush(queue, (cost + m * m, far))
                node = near
            yield -1 - node

    def search(self, q: np.ndarray, budget: float, least: int) -> list[int]:
        """Leaves in the order of the queue until they hold `budget` rows of the sample (a row counts in each tree), and
        `least` different ones."""
        leaves, held = [], 0
        different: set[int] = set()
        for leaf in self.walk(q):
            leaves.append(leaf)
            held += int(self.sizes[leaf])
            if len(different) < least:
                different.update(self.members[leaf].tolist())
            if held >= budget and len(different) >= least:
                break
        return leaves


def budget_for(forest: Forest, base: np.ndarray, k: int, recall: float = RECALL, measured: int = MEASURED) -> float:
    """Rows (counted in each tree) that the queue must pass until it has met a share `recall` of the k nearest neighbours
    which rows of the sample have in the sample. The whole table is denser, so there the same budget meets more."""
    picks = np.random.default_rng(SEED).permutation(len(base))[:measured]
    k = min(k, len(base) - 1)
    if k < 1:
        return 0.0
    at = forest.leaves_of(base)
    cost = []
    for p in picks:
        s = base @ base[p]
        s[p] = -np.inf
        left = set(np.argpartition(-s, k - 1)[:k].tolist())
        homes: dict[int, list[int]] = {}
        for j in left:
            for leaf in at[j]:
                homes.setdefault(int(leaf), []).append(j)
        held = 0
        for leaf in forest.walk(base[p]):
            held += int(forest.sizes[leaf])
            for j in homes.get(leaf, ()):
                if j in left:
                    left.remove(j)
                    cost.append(held)
            if not left:
                break
    return float(np.quantile(cost, recall, method="higher"))


def packed(counts: np.ndarray, first_leaf: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first cell, number of cells) of each leaf, and the number of all cells: neighbouring leaves of a tree share a cell
    as long as it holds them, a leaf beyond that has several cells of its own."""
    first, number = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    cells, room = 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if n > cell:
            first[leaf], number[leaf] = cells, -(-n // cell)
            cells += int(number[leaf])
            room = 0
        else:
            if leaf in first_leaf or room < n or room == 0:
                cells, room = cells + 1, cell
            first[leaf] = cells - 1
            room -= n
    return first, number, cells


def vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: with an id and a vector that is finite throughout and not all zeros."""
    kind = rows.schema[vec_col].dataType
    real = kind.elementType if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else T.DoubleType()
    v = F.col(vec_col).cast(T.ArrayType(real))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length, as they are stored."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x.astype(np.float32)
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal results wherever they stand."""
    dot = (a * b).sum(1)
    return dot / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _top(r: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest rows, nearest first, ties to the smaller id."""
    order = np.lexsort((ids, -score, r))
    r = r[order]
    if not len(r):
        return order
    start = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1))
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
    return order[rank < k]


class Cell:
    """Rows of one cell, by leaf."""

    def __init__(self, ids: np.ndarray, prints: np.ndarray, x: np.ndarray, leaves: np.ndarray):
        order = np.argsort(leaves, kind="stable")
        self.ids, self.prints, self.x = ids[order], prints[order], x[order].astype(np.float64)
        self.unit = _unit(self.x)
        self.leaves, starts = np.unique(leaves[order], return_index=True)
        self.starts = np.append(starts, len(ids))
        #: Products made so far, for tests.
        self.products = 0

    def best(self, q_ids: np.ndarray, q_prints: np.ndarray, q: np.ndarray, met: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, cosine) of each query's k nearest rows in the leaves it has met."""
        q = q.astype(np.float64)
        q_unit = _unit(q)
        leaf, of = np.concatenate(met), np.repeat(np.arange(len(met)), [len(m) for m in met])
        order = np.argsort(leaf, kind="stable")
        leaf, of = leaf[order], of[order]
        low, high = np.searchsorted(leaf, self.leaves, "left"), np.searchsorted(leaf, self.leaves, "right")
        top = np.full((len(q), k), -np.inf, np.float32)
        rs, cs, ss = [], [], []
        for i in np.flatnonzero(high > low):
            a, e = self.starts[i], self.starts[i + 1]
            who = of[low[i] : high[i]]
            s = q_unit[who] @ self.unit[a:e].T
            self.products += s.size
            own = (q_ids[who][:, None] == self.ids[a:e][None, :]) & (q_prints[who][:, None] == self.prints[a:e][None, :])
            s[own] = -np.inf
            r, c = np.nonzero((s >= top[who][:, -1:] - SLACK) & (s > -np.inf))
            rs.append(who[r])
            cs.append(c + a)
            ss.append(s[r, c])
            both = np.concatenate((top[who], s), axis=1)
            top[who] = -np.sort(-np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
        r, c, s = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (rs, cs, ss))
        # all that may be among the k nearest are measured exactly
        near = s >= top[r][:, -1] - SLACK if len(r) else np.empty(0, bool)
        r, c = r[near], c[near]
        exact = np.concatenate([cosine(q[r[i : i + 65536]], self.x[c[i : i + 65536]]) for i in range(0, len(r), 65536)]) if len(r) else np.empty(0)
        best = _top(r, self.ids[c], exact, k)
        return r[best], c[best], exact[best]


def _compare(dim: int, real: type, k: int):
    """Rows (cell, kind, id, print, vec, leaves) sorted by cell and kind, rows (0) before queries (1) -> each query's k
    nearest in the cell. A cell's rows are held, its queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cell = None, [], None
        for b in batches:
            cells = b.column(0).to_numpy()
            kinds = b.column(1).to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
                if a == e:
                    continue
                if cells[a] != now:
                    now, held, cell = cells[a], [], None
                ids, prints = (b.column(i).slice(a, e - a).to_numpy() for i in (2, 3))
                if kinds[a] == 0:
                    x = np.frombuffer(b"".join(b.column(4).slice(a, e - a).to_pylist()), real).reshape(-1, dim)
                    leaves = np.frombuffer(b"".join(b.column(5).slice(a, e - a).to_pylist()), np.int32)
                    held.append((ids, prints, x, leaves))
                    continue
                if not held and cell is None:
                    continue
                if cell is None:
                    cell, held = Cell(*(np.concatenate(z) for z in zip(*held, strict=True))), []
                for i in range(a, e, BATCH):
                    n = min(BATCH, e - i)
                    q = np.frombuffer(b"".join(b.column(4).slice(i, n).to_pylist()), real).reshape(-1, dim)
                    met = [np.frombuffer(m, np.int32) for m in b.column(5).slice(i, n).to_pylist()]
                    q_ids, q_prints = ids[i - a : i - a + n], prints[i - a : i - a + n]
                    r, c, s = cell.best(q_ids, q_prints, q, met, k)
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (q_ids[r], q_prints[r], cell.ids[c], cell.prints[c], s)], names=["query_id", "query_print", "vec_id", "print", "score"])

    return run


def _search(kept: DataFrame, dim: int, n: int, k: int, every: int, recall: float, sample: int) -> DataFrame:
    """(query_id, query_print, vec_id, print, score) of the nearest found, for vectors of one length; kept: (id, print, vec,
    first, candidate), n of them first of their copies."""
    spark = kept.sparkSession
    real = np.float32 if isinstance(kept.schema["vec"].dataType.elementType, T.FloatType) else np.float64
    # a hash decides who is in the sample, so its size is that asked for give or take a few hundredths; copies count once
    some = kept.where("first").where(F.pmod(F.xxhash64("print", F.lit(SEED)), F.lit(1 << 30)) <= int(min(1.0, sample / n) * (1 << 30)))
    picked = some.select("id", "vec").limit(2 * sample).collect() or kept.select("id", "vec").limit(1).collect()
    base = _unit(np.array([r.vec for r in sorted(picked, key=lambda r: (r.id, r.vec))], real).reshape(-1, dim))
    base = base[np.sort(np.unique(base + np.float32(0), axis=0, return_index=True)[1])]
    sampled = spark.sparkContext.broadcast(base)  # bounded by the sample

    def growing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [pickle.dumps(grow(sampled.value, LEAF, SEED * 1000 + t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, pa.binary())], names=["id", "tree"])

    grown = spark.range(0, TREES, 1, TREES).mapInArrow(growing, "id long, tree binary").collect()
    forest = Forest([pickle.loads(r.tree) for r in sorted(grown, key=lambda r: r.id)])
    budget = budget_for(forest, base, k, recall)
    least = min(k + 1, len(base))
    shared = spark.sparkContext.broadcast(forest)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = _matrix(part.column(2))
                at = f.leaves_of(_unit(x))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in at], pa.binary()), part.column(3)], names=["id", "print", "vec", "leaves", "candidate"])

    packs = "id long, print long, vec binary, leaves binary"
    indexed = materialize(kept.select("id", "print", "vec", "candidate").mapInArrow(leaves, packs + ", candidate boolean"), "indexed")
    candidates = indexed.where("candidate").drop("candidate")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            q = _unit(np.frombuffer(b"".join(b.column(2).to_pylist()), real).reshape(-1, dim))
            met = [np.array(f.search(v, budget, least), np.int32).tobytes() for v in q]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(met, pa.binary())], names=["id", "print", "vec", "leaves"])

    # an explicit number of partitions, which isn't merged at run time: the walk is the work here, not the bytes
    asked = indexed.where(F.pmod("id", F.lit(every)) == 0).drop("candidate").repartition(parts(spark))
    queries = materialize(asked.mapInArrow(walk, packs), "queries")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.members), np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["leaf", "n"])

    counts = np.zeros(len(forest.members), np.int64)  # as many as leaves, which the sample bounds
    for r in candidates.select("leaves").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[r.leaf] = r.n
    first, number, cells = packed(counts, forest.first_leaf, CELL)
    copies = max(1, -(-queries.count() // QUERIES))
    packing = spark.sparkContext.broadcast((first, number))

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = packing.value
        for b in batches:
            ids, prints = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int32).reshape(len(ids), -1)
            mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ prints.view(np.uint64)) >> np.uint64(20)
            for t in range(at.shape[1]):
                cell = first[at[:, t]] + (mixed % number[at[:, t]].astype(np.uint64)).astype(np.int64)
                for c in range(copies):
                    yield pa.RecordBatch.from_arrays([pa.array(cell * copies + c), pa.array(np.zeros(len(ids), np.int32)), *b.columns[:3], pa.array([v.tobytes() for v in at[:, t]], pa.binary())], names=names)

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = packing.value
        for b in batches:
            for i in range(b.num_rows):
                met = np.frombuffer(b.column(3)[i].as_py(), np.int32)
                copy = int(b.column(1)[i].as_py() % copies)
                n = number[met]
                leaf = np.repeat(met, n)
                cell = np.repeat(first[met], n) + np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
                order = np.argsort(cell, kind="stable")
                which, starts = np.unique(cell[order], return_index=True)
                lists = [x.tobytes() for x in np.split(leaf[order], starts[1:])]
                m = len(which)
                same = [pa.array([b.column(j)[i].as_py()] * m, b.column(j).type) for j in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(which * copies + copy), pa.array(np.ones(m, np.int32)), *same, pa.array(lists, pa.binary())], names=names)

    names = ["cell", "kind", "id", "print", "vec", "leaves"]
    cell_schema = "cell long, kind int, id long, print long, vec binary, leaves binary"
    dealt = candidates.mapInArrow(deal_rows, cell_schema).union(queries.mapInArrow(deal_queries, cell_schema))
    n_tasks = max(1, min(cells * copies, max(parts(spark), cells * copies // 8)))
    met = dealt.repartition(n_tasks, "cell").sortWithinPartitions("cell", "kind")
    found = materialize(met.mapInArrow(_compare(dim, real, k), "query_id long, query_print long, vec_id long, print long, score double"), "found")
    drop_shared(indexed, queries)
    return found


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = EVERY, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """For each row whose id is divisible by `every`: its k nearest rows by cosine, found through the forest.

    Returns query_id, rank (from 1), vec_id and score, the cosine of the original vectors in double precision; ties go
    to the smaller id. `recall` is the share of the sample's neighbours that the search must reach, whatever the number of
    rows; a search ends no earlier than with more than k rows, if there are so many.

    Defined cases: rows with a null id, or a vector that is null, zero or holds null or non-finite components, take no
    part; a cosine needs equal lengths, so vectors of each length have a forest of their own, and a query's candidates are
    those of its length; rows that repeat an id and a vector count once, while an id that repeats with other vectors
    stands for as many queries and candidates; other columns are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    # of copies, the k + 1 with the smallest ids are all that can be asked for; the limit also works before the exchange
    good = vectors(rows, id_col, vec_col).withColumn("print", F.xxhash64("vec")).distinct()
    of_copies = Window.partitionBy("print", "vec").orderBy("id")
    place = F.row_number().over(of_copies)
    some = good.withColumn("place", place).where((F.col("place") <= k + 1))
    # queries among the further copies are searched as well, but nobody needs them as candidates
    asked = good.where(F.pmod("id", F.lit(every)) == 0).withColumn("place", F.lit(k + 2))
    kept = some.unionByName(asked).groupBy("id", "print", "vec").agg(F.min("place").alias("place"))
    kept = kept.select("id", "print", "vec", (F.col("place") == 1).alias("first"), (F.col("place") <= k + 1).alias("candidate"))
    kept = materialize(kept, "vectors")
    lengths = kept.groupBy(F.size("vec").alias("dim")).agg(F.count_if("first").alias("n")).orderBy("dim").collect()
    found = [_search(kept.where(F.size("vec") == r["dim"]), r["dim"], r["n"], k, every, recall, sample) for r in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every_one = found[0]
    for f in found[1:]:
        every_one = every_one.union(f)
    # a pair that met in several trees is one
    pairs = every_one.groupBy("query_id", "query_print", "vec_id", "print").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "query_print").orderBy(F.desc("score"), "vec_id", "print")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark, sf_dir: str) -> DataFrame:
    from skein.session import table

    return nearest(table(spark, sf_dir, "embeddings"))
