import base64
import hashlib

from payflow.llm import warc

PAGES = [(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, None, None), (5, "u\r\nX: y", ""), (None, "n", "<p>x</p>"),
         (None, "n2", "only null"), (None, "n2", "only null"), (6, "l", "é" * 400_000), (1, "http://b", "<p>x</p>"), (9, "w", "\r\n\r\nWARC/1.1\r\n")]


def pages_df(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, digest string")


def expected():
    out = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        first = min(same, default=None)
        revisit = first is not None and (page is None or page > first)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_equals_brute_force(spark):
    got = warc.archive_round_trip(pages_df(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == expected()


def test_small_frames_index_and_fetch(spark, tmp):
    index = warc.write_archives(pages_df(spark), f"file://{tmp}/w", frame_bytes=300, bundle_bytes=600)
    assert index.count() == len(PAGES)
    back = warc.read_archives(spark, f"file://{tmp}/w", payloads=True)
    assert back.select("bundle").distinct().count() > 1
    want = {(r["page_id"], bytes(r["payload"])) for r in back.collect()}
    assert {(r["page_id"], bytes(r["payload"])) for r in warc.fetch(index, f"file://{tmp}/w").collect()} == want
    at = {(r["bundle"], r["frame"], r["offset_in_frame"]) for r in back.collect()}
    assert at == {(r["bundle"], r["frame"], r["offset_in_frame"]) for r in index.collect()}


def test_threshold_and_empty_table(spark, tmp):
    index = warc.write_archives(pages_df(spark), f"file://{tmp}/t", min_revisit_bytes=9)
    assert index.count() == len(PAGES)
    kinds = warc.read_archives(spark, f"file://{tmp}/t").groupBy("record_type").count().collect()
    assert {r["record_type"] for r in kinds} == {"response"}
    assert warc.archive_round_trip(pages_df(spark, [])).count() == 0


def test_seek_table_is_the_public_format():
    import zstandard
    frames = [zstandard.compress(x) for x in (b"abc", b"defgh")]
    bundle = b"".join(frames) + warc.seek_table([(len(frames[0]), 3), (len(frames[1]), 5)])
    assert [zstandard.decompress(bundle[a:a + n]) for a, n, _ in warc.frame_spans(bundle)] == [b"abc", b"defgh"]
    reader = zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True)   # a plain reader skips the table
    assert reader.read(100) == b"abcdefgh"


def test_oracle_sql_gives_the_same_rows():
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    assert sorted(con.execute(warc.oracle_sql()).fetchall(), key=repr) == expected()
