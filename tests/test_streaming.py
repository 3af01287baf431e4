import pandas as pd

from skein.operators.counters import first_last_edges
from skein.streaming import changelog as S


def stream_of(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def test_instance_edges_like_the_batch_form(spark, tmp_path):
    schema = "key string, seq long, delta int"
    batches = [[("a", 1, 1), ("a", 2, 1), ("b", 1, 1)], [("a", 3, -1), ("a", 4, -1), ("b", 2, -1)], [("a", 5, 1), ("b", 3, 1), ("b", 4, -1)]]
    out = S.run_once(S.instance_edges(stream_of(spark, tmp_path, batches, schema)), "edges", str(tmp_path / "cp"))
    got = sorted((r.key, r.seq, r.op) for r in out.collect())
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    want = sorted((r.key, r.seq, r.op) for r in first_last_edges(whole, "key", ["seq"]).collect())
    assert got == want and len(got) == 7


def test_status_stream_reports_changes_only(spark, tmp_path):
    schema = "key string, seq long, status int"
    out = S.run_once(S.status_stream(stream_of(spark, tmp_path, [[("u", 1, 1), ("u", 2, 1)], [("u", 3, 1), ("u", 4, 2)]], schema)), "statuses", str(tmp_path / "cp"))
    assert sorted((r.seq, r.status) for r in out.collect()) == [(1, 1), (4, 2)]


def test_tracked_and_wake_streams(spark, tmp_path):
    schema = "file_id long, kind int, op string"
    requests = spark.createDataFrame([(1, 1), (1, 8)], "file_id long, mask long")
    out = S.run_once(S.tracked_stream(stream_of(spark, tmp_path, [[(1, 0, "add"), (1, 5, "add"), (2, 0, "add")], [(1, 3, "remove")]], schema), requests), "tracked", str(tmp_path / "cp"))
    assert sorted((r.kind, r.op) for r in out.collect()) == [(0, "add"), (3, "remove")]


def test_swap_is_the_net_change(spark):
    old = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    new = spark.createDataFrame([(1,), (3,)], "x long")
    assert sorted((r.x, r.op) for r in S.swap_results(old, new).collect()) == [(1, "remove"), (2, "remove"), (3, "add")]
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_publish_hands_on_batches(spark, tmp_path):
    seen = []
    q = S.publish(stream_of(spark, tmp_path, [[("a", 1, 1)]], "key string, seq long, delta int"), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"), "100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 1
