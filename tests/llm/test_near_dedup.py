"""The pipeline's near-dedup stage against all pairs by exact five-word Jaccard similarity."""

import random

import corpus_pipeline as C
from skein.llm import simhash as S
from skein.session import table


def test_near_dedup_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for i in range(120):  # copies with a few words changed, at all similarities around 0.8
        words = ["w%d" % rng.randrange(10**6) for _ in range(rng.choice((12, 40, 100, 300)))]
        rows.append((10**6 + 2 * i, " ".join(words)))
        for _ in range(max(1, len(words) // rng.choice((45, 50, 60, 100)))):
            words[rng.randrange(len(words))] = "changed"
        rows.append((10**6 + 2 * i + 1, " ".join(words)))
    sets = {}
    for d, text in rows:
        words = (text or "").encode().lower().split()
        sets[d] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    far = 0
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
                far += sets[a] != sets[b]
    assert far > 40
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], docs.select(*C.COLUMNS).schema)
    got = {r.doc_id for r in C.simhash_near_dedup(spark, df, "").select("doc_id").collect()}
    assert got == {d for d in ids if find(d) == d}


def test_covering_search_alone_links_what_is_in_its_radius(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(60):  # long texts with a few words changed, so that some pairs lie within the radius, others beyond
        words = ["w%d" % rng.randrange(10**6) for _ in range(400)]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    # one word that repeats: sets of a few shingles, often alike in their bits, not in their words
    texts += [" ".join(["again"] * n + ["w%d" % rng.randrange(10**6)]) for n in range(4, 12)]
    sets = [S.text_shingles(S.words_of(t)) for t in texts]
    prints = [S.text_print(s) for s in sets]
    for s, p in zip(sets, prints, strict=True):
        assert p % 2**64 == int.from_bytes(bytes(sum(1 << 7 - b for b in range(8) if sum(int(h) >> 8 * i + 7 - b & 1 for h in s) * 2 > len(s)) for i in range(8)), "little")
    nodes = [S._hash_of(t.encode()) for t in texts]
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    near = beyond = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                if (prints[i] % 2**64 ^ prints[j] % 2**64).bit_count() <= S.RADIUS:
                    x, y = find(nodes[i]), find(nodes[j])
                    up[max(x, y)] = min(x, y)
                    near += 1
                else:
                    beyond += 1
    assert near >= 10 and beyond >= 10
    # no two texts share a band here, so that only fingerprints can bring them together
    sketches = [(i, n, 400, [i * S.BANDS + k for k in range(S.BANDS)], p) for i, (n, p) in enumerate(zip(nodes, prints, strict=True))]
    sketches = spark.createDataFrame(sketches, "id long, hash long, size int, bands array<long>, fp long")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.node: r.component for r in S.similar_components(docs, sketches).collect()}
    assert {n: got.get(n, n) for n in nodes} == {n: find(n) for n in nodes}
