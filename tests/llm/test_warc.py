import base64
import hashlib

from quarterdeck.llm import warc

SCHEMA = "page_id long, url string, html string, page_bytes string, digest string"


def expected(rows):
    first = {}
    for page_id, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        smallest = first.get(html or "")
        again = smallest is not None and (page_id is None or page_id > smallest)
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", smallest if again else None))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(p, u, h, "x", "y") for p, u, h in rows], SCHEMA)
    got = [tuple(r) for r in warc.round_trip(df).collect()]
    assert sorted(got, key=repr) == sorted(expected([(p, h) for p, _, h in rows]), key=repr)


def test_magic_inside_payloads_is_rejected(spark):
    inner = warc.MAGIC + "WARC-Type: response\r\nX-Page-ID: 99\r\nX-Payload-Length: 1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    check(spark, [(1, "http://a", "plain"), (2, "http://b", inner), (3, None, "x" + inner + inner + "y"), (4, "http://c", warc.MAGIC), (5, "u", warc.MAGIC * 3 + "tail"), (6, "u", "ends\r\n\r\n"), (7, "u", "\r\n\r\n" + inner)])


def test_copies_nulls_ties_and_odd_text(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (3, "u", "same"), (9, "u", None), (8, "u", ""), (None, "u", "same"), (None, "u", "alone"), (7, "a\r\nb: c", "é日本\n\r\n"), (10, "u", "z" * 300_000)]
    check(spark, rows)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pointer_jumping_keeps_only_the_chain():
    import numpy as np

    # 0 -> 2 -> 5 -> end; 1 -> 3 -> 5 and 4 -> 4 are off the chain
    assert warc.reachable(np.array([2, 3, 5, 5, 4, 5])).tolist() == [True, False, True, False, False, True]


def test_small_splits(spark):
    rows = [(k, "u", "".join(f"<p>{warc.MAGIC}{k}-{j}</p>" for j in range(k % 7))) for k in range(300)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_splits_that_change_between_scans(spark):
    """Fewer executors mean other splits: the second scan must not rely on the places of the first."""
    rows = [(k, "u", "".join(f"<p>{warc.MAGIC}{k}-{j % 2}</p>" for j in range(k % 7))) for k in range(300)]
    path = warc.new_path(spark, "warc")
    warc.written(spark.createDataFrame([(p, u, h, "x", "y") for p, u, h in rows], SCHEMA), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = warc.read(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "17000")
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got, key=repr) == sorted(expected([(p, h) for p, _, h in rows]), key=repr)
