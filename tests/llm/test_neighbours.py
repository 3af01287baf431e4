import numpy as np

from skein.llm import neighbours as A
from skein.session import table


def brute(ids, x, k=5, every=50):
    n = np.linalg.norm(x, axis=1)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = (x @ v) / (n * np.linalg.norm(v))
            order = sorted((-round(float(s[j]), 12), int(ids[j])) for j in range(len(ids)) if ids[j] != i)[:k]
            out[int(i)] = [j for _, j in order]
    return out


def recall_of(df, want):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) >= set(want) and all(len(v) == 5 for v in got.values())
    return sum(len(got[q] & set(w)) for q, w in want.items()) / (5 * len(want))


def test_query_against_brute_force(spark):
    for sf in ("sf0.001", "sf0.1"):
        e = table(spark, f"/root/testdata/{sf}", "embeddings").toPandas()
        x = np.array(e.embedding.tolist(), np.float64)
        at = {i: n for n, i in enumerate(e.vec_id)}
        got = A.op2_neighbours(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect()
        for r in got:
            q, v = x[at[r.query_id]], x[at[r.vec_id]]
            assert abs(r.score - q @ v / np.linalg.norm(q) / np.linalg.norm(v)) < 1e-14
        want = brute(e.vec_id.to_numpy(), x)
        found = {q: [r.vec_id for r in got if r.query_id == q] for q in want}
        assert all(len(f) == 5 for f in found.values())
        assert sum(len(set(found[q]) & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)


def test_recall_on_vectors_with_structure(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((200, 32))
    x = 0.3 * rng.standard_normal((6000, 32)) + centres[rng.integers(0, 200, 6000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall_of(A.nearest(df), brute(np.arange(6000), x)) >= 0.9


def test_structure_makes_the_search_cheap():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((1000, 32))
    x = A._unit(0.3 * rng.standard_normal((10_000, 32)) + centres[rng.integers(0, 1000, 10_000)])
    f = A.Forest.of(x)
    budget = A.budget_for(f, x, 5)
    assert budget < 0.1 * len(x)
    at = f.leaves_of(x)
    near = found = 0
    for i in range(0, 10_000, 100):
        met = set(f.search(x[i], budget, 6))
        s = x @ x[i]
        s[i] = -2
        top = np.argpartition(-s, 4)[:5]
        near += 5
        found += sum(bool(met & set(at[j].tolist())) for j in top)
    assert found >= 0.9 * near


def test_only_rows_of_met_leaves_are_multiplied():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    leaves = (np.arange(300) // 10).astype(np.int32)
    cell = A.Cell(np.arange(300), np.zeros(300, np.int64), x, leaves)
    met = [np.array([0, 7, 99], np.int32), np.array([29], np.int32)]
    r, c, s = cell.best(np.array([3, 1000]), np.zeros(2, np.int64), np.stack((x[3], x[290])), met, 5)
    assert cell.products == 30
    assert set(cell.ids[c[r == 0]] // 10) <= {0, 7} and 3 not in cell.ids[c[r == 0]] and set(cell.ids[c[r == 1]] // 10) == {29}
    own = np.array([i for i in range(300) if i // 10 in (0, 7) and i != 3])
    exact = x[own] @ x[3] / np.linalg.norm(x[own], axis=1) / np.linalg.norm(x[3])
    assert cell.ids[c[r == 0]].tolist() == own[np.argsort(-exact)][:5].tolist()


def test_cells_hold_what_they_are_told():
    counts = np.array([3, 4, 2, 30, 1, 5, 5, 1])
    first, number, cells = A.packed(counts, np.array([0, 5, 8]), 10)
    assert number.tolist() == [1, 1, 1, 3, 1, 1, 1, 1]
    assert first.tolist() == [0, 0, 0, 1, 4, 5, 5, 6] and cells == 7


def test_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, score double, rank int"
    v = lambda *x: [float(y) for y in x]
    rows = [
        (0, v(1, 0), 1.0, 1), (7, v(1, 1), 1.0, 1), (6, v(1, 1), 1.0, 1), (5, v(2, 2), 1.0, 1), (3, v(0, 1), 1.0, 1), (4, None, 1.0, 1), (8, v(0, 0), 1.0, 1), (9, v(float("nan"), 1), 1.0, 1),
        (10, v(float("inf"), 1), 1.0, 1), (11, [None, 1.0], 1.0, 1), (None, v(1, 0), 1.0, 1), (12, v(1, 2, 3), 1.0, 1), (13, [], 1.0, 1), (50, v(0, 0), 1.0, 1), (14, v(-1, 0), 1.0, 1), (15, v(-1, 0.5), 1.0, 1), (0, v(1, 0), 1.0, 1),
    ]
    got = [(r.query_id, r["rank"], r.vec_id) for r in A.nearest(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5), (0, 2, 6), (0, 3, 7), (0, 4, 3), (0, 5, 15)]
    # another length: a forest of its own
    more = [*rows, (100, v(1, 2, 2), 1.0, 1)]
    got = [(r.query_id, r["rank"], r.vec_id) for r in A.nearest(spark.createDataFrame(more, schema)).where("query_id = 100").collect()]
    assert got == [(100, 1, 12)]
    assert A.nearest(spark.createDataFrame([], schema)).count() == 0
    assert A.nearest(spark.createDataFrame(rows[:1], schema)).count() == 0


def test_copies_are_found_by_smallest_id(spark):
    rows = [(i, [1.0, 2.0]) for i in range(1, 201)] + [(300, [2.0, -1.0])]
    got = {}
    for r in A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [1, 2, 3, 4, 5] for q in (50, 100, 150, 200, 300)}


def test_copies_don_t_stop_the_forest():
    x = np.ones((500, 4), np.float32)
    f = A.Forest.of(x / 2)
    assert (f.leaves_of(x / 2) >= 0).all() and len(f.search(x[0] / 2, 10, 1)) >= 1
    assert A.budget_for(f, x[:1] / 2, 5) == 0


def test_recall_beside_a_large_group_of_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 32)) + 0.4 * rng.standard_normal((10, 32))[rng.integers(0, 10, 4000)]
    hot = rng.random(4000) < 1 / 3
    x[hot] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {q: w for q, w in brute(np.arange(4000), x).items() if not hot[q]}
    assert recall_of(A.nearest(df), want) >= 0.9
