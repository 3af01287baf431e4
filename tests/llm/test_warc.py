import gzip
import json

from skein.llm import warc as W
from skein.llm.queries import ORACLE_SQL


def test_query_against_sql(spark, duck, sf):
    got = W.op10_warc(spark, sf)
    q = duck.sql(ORACLE_SQL["op10_warc"])
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.select(*q.columns).collect()), key=key) == sorted(q.fetchall(), key=key)


def test_revisits_and_edge_cases(spark):
    x, tricky = "x" * 120, "é" * 60 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "u", None), (2, "u", "short"), (3, "u", "short"), (5, None, x), (4, "u é\r\nX: y", x), (4, "u", x), (None, "u", x), (7, "u", tricky), (8, "u", tricky), (9, "u", "z" * 3_000_000), (10, "u", "y" * 99), (11, "u", "y" * 99)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, kind string").repartition(3)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in W.warc_roundtrip(df).collect()), key=str)
    n = len(tricky.encode())
    want = [(1, 0, "response", None), (2, 5, "response", None), (3, 5, "response", None), (5, 120, "revisit", 4), (4, 120, "response", None), (4, 120, "response", None), (0, 120, "revisit", 4), (7, n, "response", None), (8, n, "revisit", 7), (9, 3_000_000, "response", None), (10, 99, "response", None), (11, 99, "response", None)]
    assert got == sorted(want, key=str)
    assert W.warc_roundtrip(df.limit(0)).count() == 0


def test_members_stand_alone_and_the_index_fits(tmp_path):
    parts = [W._record(i, f"http://h/{i}", bytes([65 + i]) * (300 * i), "d", "response", None) for i in range(6)]
    plain = b"".join(h + b + b"\r\n\r\n" for h, b in parts)
    src, dst = tmp_path / "a.warc.gz", tmp_path / "b.warc.gz"
    src.write_bytes(gzip.compress(plain[:700]) + gzip.compress(plain[700:]))  # members that cut records anywhere
    assert W.normalise(f"file://{src}", f"file://{dst}") == 6
    raw = dst.read_bytes()
    assert gzip.decompress(raw) == plain
    index = [json.loads(x) for x in (tmp_path / "b.warc.gz.idx").read_text().splitlines()]
    for (head, body), e in zip(parts, index, strict=True):
        assert gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]) == head + body + b"\r\n\r\n"
    again = tmp_path / "c.warc.gz"
    assert W.normalise(f"file://{dst}", f"file://{again}") == 6 and again.read_bytes() == raw
    assert not list(tmp_path.glob("*.tmp"))


def test_damaged_streams_are_reported(tmp_path):
    src = tmp_path / "a.warc.gz"
    src.write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))
    for data in (src.read_bytes(), gzip.compress(b"x" * 1000)[:-20]):
        src.write_bytes(data)
        try:
            W.normalise(f"file://{src}", f"file://{tmp_path}/o.gz")
        except (ValueError, KeyError):
            continue
        raise AssertionError("no error")
