import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from tessera.llm import warc

PAGES = "page_id long, url string, html string"


def archive_of(n, compress=True):
    rng = random.Random(n)
    raws = [warc.record("response", f"http://x/{k}", k, (p := rng.randbytes(rng.randrange(0, 400))), warc.digest_of(p), None) for k in range(n)]
    return [warc.member(r) if compress else r for r in raws]


def read(data):
    out = list(warc.salvage(data))
    return [x.fields["warc-target-uri"].rpartition("/")[2] for x in out if isinstance(x, warc.Record)], [x for x in out if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("compress", [True, False])
def test_whole(compress):
    assert read(b"".join(archive_of(9, compress))) == ([str(k) for k in range(9)], [])
    assert read(b"") == ([], [])


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_a_damaged_record_costs_itself_only(compress, seed):
    parts = archive_of(9, compress)
    rng = random.Random(seed)
    k = rng.randrange(9)
    start = sum(map(len, parts[:k]))
    hurt = bytearray(parts[k])
    for _ in range(3):
        hurt[rng.randrange(len(hurt))] ^= rng.randrange(1, 256)
    names, gaps = read(b"".join([*parts[:k], bytes(hurt), *parts[k + 1 :]]))
    assert names in ([str(i) for i in range(9) if i != k], [str(i) for i in range(9)])  # a byte that nothing checks may have changed
    if len(names) == 8:
        assert [(g.start, g.end) for g in gaps] == [(start, start + len(parts[k]))]


@pytest.mark.parametrize("compress", [True, False])
def test_cuts_and_junk(compress):
    parts = archive_of(5, compress)
    names, gaps = read(b"junk" + parts[0] + parts[1][:-9] + parts[2] + b"\x1f\x8b\x08WARC/1.1\r\n" + parts[3] + parts[4][:10])
    assert names == ["0", "2", "3"] and len(gaps) == 4
    assert gaps[0][:2] == (0, 4) and sum(g.end - g.start for g in gaps) == 4 + len(parts[1]) - 9 + 13 + 10


def test_payload_with_version_lines():
    payload = b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 3
    raw = warc.record("response", "u", 1, payload, warc.digest_of(payload), None)
    assert [x.payload() for x in warc.salvage(raw + raw)] == [payload, payload]
    names, gaps = read(zlib.compress(b"no member") + warc.member(raw))
    assert len(names) == 1 and len(gaps) == 1


ROWS = [(1, "http://a", "one"), (2, "http://b\r\nX: y", "one"), (3, None, None), (4, "c", ""), (5, "d", "zwei ü"), (9, "e", "one"), (9, "e", "one"), (7, "f", "x" * 200_000), (8, "g\U0001f600", "\x00\x01")]


def test_pages_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).withColumns({c: F.lit(1) for c in ("key", "sha1", "payload", "n", "last")})
    root, made = warc.archive(pages, str(tmp_path / "w"))
    assert made.agg(F.sum("records")).first()[0] == len(ROWS)
    got = warc.read_archives(spark, f"{root}/part-*").collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(brute.op6([(k, h) for k, _, h in ROWS]))
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response"} == {(k, h or "") for k, _, h in ROWS if k in (9, 4, 5, 7, 8)}


def test_small_files_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(40)], PAGES).coalesce(1)
    made = warc.write_archives(warc.revisits(pages), str(tmp_path / "w"), file_bytes=2000)
    assert made.agg(F.sum("files")).first()[0] > 4
    one = sorted((tmp_path / "w").glob("part-*/*"))[0]
    data = bytearray(one.read_bytes())
    data[30] ^= 255
    one.write_bytes(bytes(data))
    got = warc.read_archives(spark, str(tmp_path / "w" / "part-*"))
    assert got.where("record_type <> 'gap'").count() == 39
    gap = got.where("record_type = 'gap'").first()
    assert gap["offset"] == 0 and gap["gap_end"] > 100 and gap["reason"].startswith("gzip")


def test_least_size_and_null_key(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (None, "u", "abc")], PAGES)
    got = {r["key"]: (r["kind"], r["refers_to"]) for r in warc.revisits(pages, least=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("revisit", 4)}


def test_empty(spark, data, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.query(spark, str(tmp_path)).count() == 0


def test_query_against_plain(spark, data):
    pages = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html").collect()]
    got = warc.query(spark, data)
    assert sorted(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()) == brute.op6(pages)


def test_members_of_several_records():
    records = [warc.record("response", "u", k, b"page %d" % k * 40, warc.digest_of(b"page %d" % k * 40), None) for k in range(6)]
    bad = bytearray(b"".join(records[1:4]))
    bad[len(records[1]) + len(records[2]) - 60] ^= 1
    data = warc.member(records[0]) + warc.member(bytes(bad)) + warc.member(records[5])
    got = list(warc.salvage(data))
    assert [x.fields["warc-record-id"] if isinstance(x, warc.Record) else "gap" for x in got] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>", "gap", "<urn:page:5>"]
    cut_off = warc.member(records[0] + records[1] + records[2])
    got = list(warc.salvage(cut_off[: len(cut_off) - 30]))
    assert [isinstance(x, warc.Record) for x in got] == [True] * (len(got) - 1) + [False] and 1 <= len(got) <= 3


def test_folders_of_lost_attempts_are_passed_over(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(10)], PAGES)
    root, made = warc.archive(pages, str(tmp_path / "w"))
    lost = tmp_path / "w" / "part-000000-lost"
    lost.mkdir()
    (lost / "00000.warc.gz").write_bytes(warc.member(warc.record("response", "u", 77, b"x", warc.digest_of(b"x"), None)))
    got = warc.written(warc.read_archives(spark, f"{root}/part-*"), made)
    assert sorted(r["page_id"] for r in got.collect()) == list(range(10))
