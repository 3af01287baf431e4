import zlib

import numpy as np

from skein.llm import langid as L
from skein.llm import quality as Q
from skein.session import table

SF = "/root/testdata/sf0.01"


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_quality_on_the_held_out_fold(spark):
    got = {r.doc_id: r for r in Q.op3_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert len(got) == table(spark, SF, "documents").count()
    assert all(r.held_out == fold(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, k) for i, k in labels.items() if i in got and fold(i)]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_quality_edge_cases(spark):
    schema = "doc_id long, text string, quality int, score double"
    good, bad = "the quick text of words ", "xx%% yy## zz!! "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5), 0, 0.0) for i in range(60)] + [(None, good, 0, 0.0), (61, None, 0, 0.0), (62, "", 0, 0.0), (62, "", 0, 0.0), (63, good * 9000, 0, 0.0)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = Q.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert len({r.score for r in got if r.doc_id in (61, 62)}) == 1
    kept = Q.score_documents(docs, model, keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert Q.score_documents(docs.limit(0), model).count() == 0
    none = Q.fit(docs, labels.limit(0))
    assert {r.score for r in Q.score_documents(docs, none).collect()} == {0.5}


def test_quality_never_reads_the_held_out_labels(spark):
    docs = spark.createDataFrame([(i, "text %d" % i) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if fold(i) else 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {k for _, k in Q.labelled_sample(docs, labels, "doc_id", "text", "quality", 100)} == {0}


def test_one_number_a_feature_is_the_whole_model():
    texts, labels = ["aa bb aa", "cc dd", "aa cc", "dd dd bb"], [1, 0, 1, 0]
    weights, bias = Q.train(texts, labels)
    for t in texts:
        ids, w = Q.bag(t, {})
        assert abs(Q.Scorer(weights, bias)(t) - (float(weights[ids] @ w) + bias)) < 1e-4


def test_language_on_the_held_out_fold(spark):
    got = {r.doc_id: r for r in L.op4_langid(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    held = [(got[d.doc_id].lang_pred, d.lang) for d in docs if d.lang and fold(d.doc_id)]
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score double, held_out int"
    rows = [(i, ("abba baba " if i % 2 else "xyzzy zyx ") * 5, "ab" if i % 2 else "xy", 0.0, 1) for i in range(40)] + [(None, "abba", None, 0.0, 1), (50, None, "ab", 0.0, 1), (51, " 12!", "xy", 0.0, 1), (52, "", None, 0.0, 1), (53, "ABBA BABA " * 20_000, None, 0.0, 1), (53, "baba", None, 0.0, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = L.identify(docs, L.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert by[50] == by[51] == by[52] == ["und"] and by[53] == ["ab", "ab"] and by[None] == ["ab"]
    assert all(by[i] == ["ab" if i % 2 else "xy"] for i in range(40))
    assert L.identify(docs.limit(0), L.fit(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.fit(docs.limit(0))).collect()} == {"und"}


def test_bundles_are_sums_of_bound_trigrams():
    v, n = L.text_vectors(["abc"])
    a, b, c = L._letters()
    s = [0, *(int(L._symbol_of()[ord(x)]) for x in "abc"), 0]
    want = sum((a[s[i]] * b[s[i + 1]] * c[s[i + 2]]).astype(int) for i in range(3))
    assert n[0] == 3 and (v[0] == want).all()
