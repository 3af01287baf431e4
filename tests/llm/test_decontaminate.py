import random
from collections import Counter

import numpy as np

from skein.llm import decontaminate as D
from skein.session import table

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
OTHER = "north east south west up down left right front back near far high low fast slow warm cold dry wet"


def host(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_copies_and_paraphrases_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(40):
        words = host(rng, 120)
        if i % 4 == 0:
            p = ITEM.split()
        elif i % 4 == 1:  # three words changed, the answer kept
            p = ITEM.split()
            for j in (1, 4, 9):
                p[j] = "changed"
        elif i % 4 == 2:  # the first seven words only
            p = ITEM.split()[:7]
        else:
            p = []
        at = rng.randrange(100)
        rows.append((i, " ".join(words[:at] + p + words[at:]).replace("alpha", "Alpha,"), i))
        if i % 4 < 2:
            want.add(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string, cosine int")
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    got = D.find_leaks(docs, bench).collect()
    assert {r.doc_id for r in got} == want and {r.item_id for r in got} == {1}
    assert all(0 < r.overlap <= 1 and r.cosine >= D.COSINE for r in got)
    left = D.drop_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(40)) - want


def test_edge_cases(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "!!! ... ?"), (None, "x " + ITEM + " y"), (4, ITEM.upper() + "."), (4, ITEM.upper() + "."), (5, ("w " * 30_000) + ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in D.find_leaks(docs, bench).collect())
    assert sorted(set(got)) == [(0, 1), (4, 1), (5, 1)]
    assert D.find_leaks(docs.limit(0), bench).count() == 0
    assert D.find_leaks(docs, bench.limit(0)).count() == 0
    assert D.drop_leaks(docs, bench.limit(0)).count() == len(rows)


def test_blocks_give_the_same(spark):
    rng = random.Random(8)
    long = " ".join(f"l{j}" for j in range(400))
    items = [(i, " ".join(f"i{i}x{j}" for j in range(20 + i))) for i in range(9)] + [(9, long)]
    docs = spark.createDataFrame([(i, " ".join(host(rng, 50)) + " " + t[:700]) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, D.find_leaks(docs, bench, block=n).collect())) for n in (20_000, 4))
    assert [x[:3] for x in one] == [x[:3] for x in many] and {x[:2] for x in one} == {(i, i) for i, _ in items}
    assert np.allclose([x[3] for x in one], [x[3] for x in many], atol=1e-4)
    assert D.drop_leaks(docs, bench, block=4).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "机器学习模型需要大量训练数据来提高准确率"
    bench = spark.createDataFrame([(1, "the capital city?"), (2, "Paris"), (3, "of France is"), (4, chinese), (5, "你好世界")], "item_id long, text string")
    rows = [(1, "what is The capital, city then"), (2, "a line\nPARIS.\nanother"), (3, "Paris is large"), (4, "前言部分" + chinese + "后记部分"), (5, "他说你好世界然后走了"), (6, "capital the city of is France"), (7, "世界你好"), (8, "x of France is y")]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 2), (4, 4), (5, 5), (8, 3)}


def brute(words, passage):
    """Whether any stretch of a text holds the passage as the docstring says, and by which share, over all places."""
    n = len(passage)
    if sum((Counter(words) & Counter(passage)).values()) < D.PARAPHRASED * n:
        return 0.0
    reach, best = n + n // 4 + 2, 0.0
    for i in range(max(1, len(words) - reach + 1)):
        piece = words[i : i + reach]
        if sum((Counter(piece) & Counter(passage)).values()) < D.PARAPHRASED * n:
            continue
        share, answer = D.common_subsequence(passage, piece) / n, passage[-D.ANSWER_WORDS :]
        if share >= D.COPIED or (share >= D.PARAPHRASED and D.common_subsequence(answer, piece) >= D.ANSWERED * len(answer)):
            best = max(best, share)
    return best


def test_against_common_subsequences_over_all_places(spark, sf):
    """All documents against all items, with paraphrases planted: 25, 35 and 45 % of the words before the answer changed."""
    rng = random.Random(12)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    texts = [r.text or "" for r in table(spark, sf, "documents").select("text").collect()]
    plain = [t for t in texts if 60 < len(t.split()) < 400]
    for _, text in items:
        for share in (0.25, 0.35, 0.45):
            words = text.split()
            head = max(1, len(words) - D.ANSWER_WORDS)
            for j in rng.sample(range(head), int(share * head)):
                words[j] = rng.choice(rng.choice(plain).split())
            around = rng.choice(plain).split()
            at = rng.randrange(len(around))
            texts.append(" ".join(around[:at] + words + around[at:]))
    want = {}
    for d, t in enumerate(texts):
        words = D.words_in(t)
        for i, text in items:
            share = max((brute(words, p) for p in D.passages_of(text)), default=0)
            if share:
                want[d, i] = share
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, table(spark, sf, "benchmark")).collect()}
    assert got <= set(want)
    missed = set(want) - got
    print(len(want), "hold an item,", len(missed), "missed")
    assert len(want) > 100 and len(missed) <= 0.02 * len(want) and not any(want[x] >= 0.8 for x in missed)


def test_svd_finds_the_leading_space(spark):
    rng = random.Random(1)
    texts = [" ".join(f"t{k % 5}_{rng.randrange(12)}" for _ in range(30)) for k in range(60)]
    terms = sorted({w for t in texts for w in t.split()})
    idf = np.ones(len(terms))
    v = D.randomised_svd(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), terms, idf, rank=5)
    a = np.zeros((60, len(terms)))
    for i, t in enumerate(texts):
        ids, w = D.tf_idf(np.array([terms.index(x) for x in t.split()]), idf)
        a[i, ids] = w
    exact = np.linalg.svd(a, full_matrices=False)[2][:5]
    assert np.linalg.norm(a @ v) >= 0.999 * np.linalg.norm(a @ exact.T)


def test_common_subsequence_against_the_table():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert D.common_subsequence(a, b) == t[-1][-1]


def test_document_counts_against_plain_counting(spark):
    texts = ["Alpha, beta beta. (gamma)", "alphabet «beta» -- gamma-delta", "", None, "ALPHA"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    terms = ["alpha", "beta", "gamma", "gamma-delta", "none"]
    df, n = D.document_counts(docs, terms, "text")
    want = [sum(t in {D.normal(w) for w in (x or "").split()} for x in texts) for t in terms]
    assert df.tolist() == want and n == 5
