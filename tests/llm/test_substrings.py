import random

from skein.llm import substrings as S


def planted(seed, n, length):
    rng = random.Random(seed)
    rows = []
    for p in range(n):
        passage = [f"p{p}_{rng.randrange(400)}" for _ in range(length)]
        for _ in range(2):
            i = len(rows)
            h = [f"h{i}_{rng.randrange(300)}" for _ in range(rng.randrange(80, 200))]
            at = rng.randrange(len(h))
            rows.append((i, " ".join(h[:at] + passage + h[at:])))
    return rows


def test_embedded_passages_are_found_and_clean_texts_are_not(spark):
    rows = planted(1, 30, 60)
    clean = [(1000 + i, " ".join(f"c{i}_{j}" for j in range(150)) + "\nA common line of nine words stands here too.") for i in range(20)]
    got = S.repeated_passages(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got}
    assert len(found & {i for i, _ in rows}) >= 58 and not found & {i for i, _ in clean}
    assert all(r.component_id == r.doc_id - r.doc_id % 2 and r.keep == (r.doc_id % 2 == 0) for r in got)


def test_similar_paragraphs_against_all_pairs(spark):
    rng = random.Random(4)
    base = [[f"b{k}_{j}" for j in range(70)] for k in range(6)]
    lines = []
    for i in range(40):
        w = list(base[i % 6])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(70)] = f"edit{i}_{rng.randrange(9)}"
        lines.append((i, w))
    sets = {i: S.shingles([x.encode() for x in w]) for i, w in lines}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and S.jaccard(sets[i], sets[j]) >= S.SIMILAR:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    rows = [(i, f"own start {i}\n" + " ".join(w) + f"\nown end {i}") for i, w in lines]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'paragraph'")
    by = {r.doc_id: r.component_id for r in got.collect()}
    linked = {i for i in sets if sum(find(j) == find(i) for j in sets) > 1}
    assert linked <= set(by)
    # paragraphs may be joined further by the windows they share, never less
    assert all(by[i] == by[j] for i in linked for j in linked if find(i) == find(j))


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    base = [f"b{j}" for j in range(80)]
    paras = [base[:i] + [f"x{i}"] + base[i + 1 :] for i in range(60)]
    rows = [(i, "\n".join([" ".join(w)])) for i, w in enumerate(paras)]
    monkeypatch.setattr(S, "BLOCK", 4)
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'paragraph'")
    assert {r.component_id for r in got.collect()} == {0} and got.count() == 60


def test_edge_cases(spark):
    schema = "doc_id long, text string, kind string, keep boolean"
    p = " ".join(f"same{j}" for j in range(70))
    rows = [(1, None, "", None), (2, "", "", None), (3, p, "", None), (3, p, "", None), (None, "a b", "", None), (4, "of " * 30_000, "", None)]
    assert S.repeated_passages(spark.createDataFrame(rows, schema)).count() == 0  # one document alone is no repeat
    rows += [(None, p, "", None), (8, "x " + p, "", None)]
    got = S.repeated_passages(spark.createDataFrame(rows, schema)).collect()
    assert {r.doc_id for r in got} == {3, None, 8} and {r.component_id for r in got} == {3}
    assert {r.doc_id for r in got if r.keep} == {3}
    assert S.repeated_passages(spark.createDataFrame([], schema)).count() == 0
