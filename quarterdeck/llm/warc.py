"""Operator 1: WARC archives of pages, written, and read back with boundary-chain verification.

Writing. Every page is one WARC/1.1 record whose block is a short HTTP head and, for a response, the html. Of
pages with equal payloads the smallest page_id is the response and the others are revisit records without
payload, which name it. Records go through Spark's text writer, whose line separator is the
two line ends that close a record, so that commit, retry and the store are Spark's own.

Reading. The magic "WARC/1.1" may also stand inside a payload. Spark's text reader splits the files at every
magic, so tasks read ranges of a file in parallel and emit each candidate's length and the length its header
declares, that is, its successor's offset. For each file, pointer jumping from offset 0 (every
candidate's jump doubles in each round) keeps the candidates that the chain of records reaches; a magic
in a payload is on no chain. A file holds at most RECORDS_PER_FILE records; its candidates are these and the magics in its
payloads, whose number only the payloads' bytes bound, and one task chains them.
A payload that holds magics is put together from its candidates again, and every payload is held against its digest.
Those candidates are found by the hash of what they hold: how Spark splits the files follows from the cores it has,
so a candidate's place in one scan need not be its place in the next, after an executor was lost.

Defined results: null html is an empty payload; pages of one payload that tie for the smallest page_id are all
responses; a null page_id is smaller than none (it is the response only where all are null, and then no page
refers to it); a null url leaves the header out; no pages give no rows; other columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm.storage import new_path, removed, saved

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS_PER_FILE = 50_000
LEAST_REVISIT = 0

READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> tuple[DataFrame, str]:
    """One row per page with its record as text; the path of the table of repeated payloads that it reads."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    repeated = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # Written first, so that its size is known: Spark then broadcasts a small one and sorts for a large one.
    repeated, path = saved(repeated.where("n > 1").drop("n"), "repeated")
    rows = rows.join(repeated, "digest", "left")
    revisit = F.coalesce((F.col("page_id") > F.col("first_id")) | (F.col("page_id").isNull() & F.col("first_id").isNotNull()), F.lit(False))
    url = F.regexp_replace("url", "[\\r\\n]", "%0A")
    identity = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest")))
    uuid = F.concat_ws("-", *(F.substring(identity, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")),
        F.lit("WARC-Date: 2025-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("first_id").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.lit(len(HTTP)) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
    ]
    payload = F.when(revisit, "").otherwise(F.col("html"))
    return rows.select(F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), F.lit(HTTP), payload).alias("value")), path


def written(pages: DataFrame, path: str) -> None:
    rows, repeated = records(pages)
    rows.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    removed(pages.sparkSession, repeated)


def reachable(successor: np.ndarray) -> np.ndarray:
    """Nodes on the chain from node 0; a node without a successor points at itself."""
    on = np.zeros(len(successor), bool)
    on[:1] = True
    jump = successor.copy()
    while True:
        known = int(on.sum())
        on[jump[on]] = True
        if int(on.sum()) == known:
            return on
        jump = jump[jump]


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """One file's candidates to its records, each with the candidates that it spans."""
    file = rows["file"].iloc[0]
    rows = rows.sort_values(["block", "place"], kind="stable").reset_index(drop=True)
    rows = rows.iloc[1:].reset_index(drop=True)  # what stands before the first magic: nothing
    size = rows["size"].to_numpy(np.int64) + len(MAGIC)
    offset = np.cumsum(size) - size
    valid = (rows["content"].notna() & rows["head"].notna()).to_numpy()
    end = offset + len(MAGIC) + rows["head"].fillna(0).to_numpy(np.int64) + rows["content"].fillna(0).to_numpy(np.int64) + len(END)
    own = np.arange(len(offset))
    at = np.searchsorted(offset, end)
    hit = valid & (at < len(offset)) & (offset[np.minimum(at, len(offset) - 1)] == end) if len(offset) else valid
    closing = valid & (end == size.sum())
    on = reachable(np.where(hit, at, own)) if len(offset) else np.zeros(0, bool)
    if len(offset) and not closing[on].any():
        raise ValueError("the chain of records does not reach the end of an archive")
    last = np.where(hit, at, np.where(closing, len(offset), own + 1))
    out = rows.loc[on, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest"]].copy()
    whole = out["digest"].notna()
    if (whole & (out["record_type"] == "response") & (out["digest"] != out["payload_digest"])).any():
        raise ValueError("a payload differs from its record's digest")
    out["file"] = file
    out["first"] = offset[on]
    out["spans"] = [rows["key"].iloc[k : last[k]].tolist() if last[k] - k > 1 else None for k in np.flatnonzero(on).tolist()]
    return out.drop(columns="digest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path."""
    lines = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumns({"place": F.monotonically_increasing_id(), "key": F.xxhash64("value")})
    head = F.expr(r"CASE WHEN instr(value, '\r\n\r\n') > 0 THEN substring_index(value, '\r\n\r\n', 1) END")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("header", rf"(?:^|\n){name}: *([^\r\n]*)", 1), F.lit(""))

    rows = lines.withColumn("header", head)
    rows = rows.withColumns({"size": F.octet_length("value").cast("long"), "head": (F.octet_length("header") + len(END)).cast("long"), "content": field("Content-Length").try_cast("long")})
    whole = F.col("size") == F.col("head") + F.col("content") + len(END)
    rows = rows.withColumn("record", F.when(whole, F.col("value")))
    chain = rows.select(
        "file", "block", "place", "key", "size", "head", "content",
        field("X-Page-ID").try_cast("long").alias("page_id"),
        field("X-Payload-Length").try_cast("long").alias("payload_bytes"),
        F.regexp_extract("header", r"(?:^|\n)WARC-Payload-Digest: sha1:([A-Z2-7]*)", 1).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page-ID").try_cast("long").alias("refers_to"),
        base32_sha1(payload("record").cast("binary")).alias("digest"),
    ).groupBy("file").applyInPandas(_chained, f"{READ}, file string, first long, spans array<long>")
    chain, _ = saved(chain, "chain")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain = chain.where("spans IS NULL").select(columns)
    if chain.where("spans IS NOT NULL").isEmpty():
        return plain
    # Payloads that hold the magic: their candidates, in order, make the record again.
    parts = chain.where("spans IS NOT NULL").select(*columns, "file", "first", F.posexplode("spans").alias("nth", "key"))
    needed = lines.select("file", "key", "value").join(parts.select("file", "key").distinct(), ["file", "key"], "left_semi")
    parts = parts.join(needed.dropDuplicates(["file", "key"]), ["file", "key"])
    joined = parts.groupBy("file", "first", *columns).agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("parts"))
    joined = joined.withColumn("record", F.array_join(F.col("parts.value"), MAGIC))
    same = F.assert_true((F.col("record_type") != "response") | (base32_sha1(payload("record").cast("binary")) == F.col("payload_digest")), F.lit("a payload differs from its record's digest"))
    return plain.unionByName(joined.where(same.isNull()).select(columns))


def payload(record: str) -> Column:
    """What follows the record's header and HTTP head, without the record's end."""
    block = f"substring({record}, instr({record}, '\\r\\n\\r\\n') + 4)"
    return F.expr(f"substring({block}, instr({block}, '\\r\\n\\r\\n') + 4, length({block}) - instr({block}, '\\r\\n\\r\\n') - 7)")


def round_trip(pages: DataFrame) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    written(pages, path)
    return read(pages.sparkSession, path)


#: DuckDB SQL for round_trip().
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
m AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d.h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1) FOR k IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM d JOIN m USING (h)
"""
