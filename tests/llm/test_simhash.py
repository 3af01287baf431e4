import random

import numpy as np
import xxhash

from skein.llm import simhash as S
from skein.llm.common import components
from skein.session import table

SCHEMA = "doc_id long, text string, fp string, tab int, key long"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for x in words for w in x.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(pairs):
    """{id: smallest id reachable} over ids with fingerprints, by comparing all."""
    up = {i: i for i, _ in pairs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in pairs:
        for j, b in pairs:
            if i < j and (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in pairs}


def test_masks_cover_every_pair():
    rng = random.Random(1)
    for _ in range(3000):
        d = sum(1 << p for p in rng.sample(range(64), rng.randrange(4)))
        hit = [t for t, m in enumerate(S.MASKS) if not d & m]
        assert hit and any(not d & m for m in S.fine_masks(hit[0]))
    assert all(bin(m).count("1") >= 48 for m in S.FINE)


def test_query_against_all_pairs(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    fps = {d: plain_fingerprint(t) for d, t in docs.items()}
    want = classes(sorted(fps.items()))
    got = S.op1_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (format(f, "016x"), want[d]) for d, f in fps.items()}


def test_buckets_beyond_the_limit_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    nodes = [(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)]
    df = spark.createDataFrame(nodes, "fp long, node long")
    want = {i: c for i, c in classes(list(enumerate(fps))).items()}
    for bucket in (3, 4096):
        got = {r.node: r.component for r in components(S.hamming_links(df, bucket)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_edge_cases(spark):
    rows = [(5, None, "x", 1, 1), (4, "", "x", 1, 1), (7, " \t\n", None, None, None), (1, "one", "", 0, 0), (2, "One", "", 0, 0), (3, "one two", "", 0, 0), (None, "one", "", 0, 0), (None, "alone here now", "", 0, 0), (9, "é" * 70_000, "", 0, 0), (9, "é" * 70_000, "", 0, 0)]
    got = S.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    zero = "0" * 16
    assert {by[5, zero], by[4, zero], by[7, zero]} == {4}
    one = format(plain_fingerprint("one"), "016x")
    assert by[1, one] == by[2, one] == by[None, one] == 1
    assert by[None, format(plain_fingerprint("alone here now"), "016x")] is None
    assert S.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (2, "quite another text here", "z"), (1, "a b c d", "y"), (None, "a b c d", "n")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r.doc_id or 0, r.source) for r in kept.collect()) == [(0, "n"), (1, "y"), (2, "z")]
    assert kept.columns == ["doc_id", "text", "source"]
