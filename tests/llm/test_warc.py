import base64
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from passagekit.llm import common, warc

SCHEMA = "page_id long, url string, html string, offset string, value string, first long"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least=0):
    out = []
    for i, _, html in rows:
        text = html or ""
        ids = [j for j, _, other in rows if (other or "") == text and j is not None]
        again = bool(ids) and i != min(ids) and len(text.encode()) >= least
        out.append((i, len(text.encode()), digest(text), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


def fake(text):
    return f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 666\r\nContent-Length: {len(text)}\r\n\r\n{text}\r\n\r\n"


def pages(rng):
    rows = [(n, f"http://example.org/{n}", "".join(rng.choices("ab \r\nWé", k=rng.randint(0, 60)))) for n in range(40)]
    odd = [
        None, "", "WARC/1.1\r\n", "WARC/1.1\r\nWARC/1.1\r\n", "\r\n\r\n\r\n\r\n", "WARC/1.1", "x WARC/1.1\r\nContent-Length: 5\r\n\r\nhello", fake("one"),
        fake("one") + fake("two") + "tail", fake(fake("nested")), "a" * 5000 + "WARC/1.1\r\n" + "b" * 5000, "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\nx",
    ]
    rows += [(100 + n, "http://example.org/odd\r\nWARC/1.1\r\n", t) for n, t in enumerate(odd)]
    rows += [(n, None, "the same") for n in (9, 7, 8)] + [(7, None, "the same"), (None, "u", "the same"), (None, None, "no id"), (None, None, "no id")]
    rows += [(n, None, fake("copied")) for n in (300, 200)]
    return rows


def written(spark, rows, path, **options):
    frame = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(3)
    warc.write_archives(frame, path, **options)
    return path


@pytest.mark.parametrize("split", [97, 1000, 1 << 27])
def test_pages_come_back_whatever_their_payloads_and_the_splits_hold(spark, tmp_path, split):
    rows = pages(random.Random(split))
    path = written(spark, rows, str(tmp_path / "w"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        records = warc.read_records(spark, path)
        got = sorted((tuple(r) for r in warc.pages_back(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == plain(rows)
    assert all(r.whole and (r.stated_digest == r.payload_digest or r.record_type == "revisit") for r in records.collect())
    # every archive's chain goes from its first byte to its last one
    sizes = {name.rsplit("/", 1)[1]: len(open(name, "rb").read()) for name in glob.glob(f"{path}/part-*")}
    ends = {r.file.rsplit("/", 1)[1]: (r.low, r.high, r.n, r.bytes) for r in records.groupBy("file").agg(F.min("offset").alias("low"), F.max("next").alias("high"), F.count("*").alias("n"), F.sum(F.col("next") - F.col("offset")).alias("bytes")).collect()}
    assert ends == {name: (0, size, ends[name][2], size) for name, size in sizes.items() if size}


def test_smaller_payloads_are_all_responses_and_empty_tables_pass(spark, tmp_path):
    rows = [(n, None, t) for n, t in enumerate(["short", "short", "long enough", "long enough", None, ""])]
    got = warc.pages_back(warc.read_records(spark, written(spark, rows, str(tmp_path / "a"), least=6)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 6)
    assert warc.pages_back(warc.read_records(spark, written(spark, [], str(tmp_path / "b")))).count() == 0


def test_broken_chains_end_and_gzipped_archives_are_read(spark, tmp_path):
    record = lambda n, text: f"WARC/1.1\r\nWARC-Type: resource\r\nX-Page-Id: {n}\r\nContent-Length: {len(text)}\r\n\r\n".encode() + text + b"\r\n\r\n"
    whole = [record(n, bytes([255, 254, n]) * (n + 1)) for n in range(6)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/damaged.warc").write_bytes(b"".join(whole[:3]) + record(3, b"abc").replace(b"th: 3", b"th: 4") + b"".join(whole[4:]))
    (tmp_path / "c/short.warc").write_bytes(b"".join(whole)[:-9])
    (tmp_path / "c/headless.warc").write_bytes(b"junk" + b"".join(whole))
    with gzip.open(tmp_path / "c/all.warc.gz", "wb") as out:
        out.write(b"".join(whole))
    found = {}
    for r in warc.read_records(spark, str(tmp_path / "c")).collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.page_id, r.whole, r.payload_bytes))
    good = [(n, True, 3 * (n + 1)) for n in range(6)]
    found = {k: sorted(v) for k, v in found.items()}
    assert found == {"all.warc.gz": good, "damaged.warc": [*good[:3], (3, True, 4)], "short.warc": [*good[:5], (5, False, None)]}
    digests = {r.page_id: r.payload_digest for r in warc.read_records(spark, str(tmp_path / "c/all.warc.gz")).collect()}
    assert digests == {n: base64.b32encode(hashlib.sha1(bytes([255, 254, n]) * (n + 1)).digest()).decode() for n in range(6)}


def test_pointer_jumping_against_a_walk(spark):
    rng, rows = random.Random(5), []
    for file in range(5):
        offsets = sorted(rng.sample(range(1, 3000), 250)) if file else list(range(1, 120))
        offsets = [0, *offsets]
        for n, at in enumerate(offsets):
            to = offsets[min(n + rng.choice([1, 1, 1, 1, 2, 5]), len(offsets) - 1)] if rng.random() < 0.995 else rng.choice([None, at + 4001])
            rows.append((f"f{file}", at // 300 * 300, at, to if to is None or to > at else at + 4001))
    want = set()
    for file in range(5):
        after = {at: to for f, _, at, to in rows if f == f"f{file}"}
        at = 0
        while at in after:
            want.add((f"f{file}", at))
            at = after[at]
    got = warc.reached(spark.createDataFrame(rows, "file string, block long, offset long, next long")).collect()
    assert {(r.file, r.offset) for r in got} == want and len(got) == len(want)


def test_op11_on_the_tables(spark):
    got = warc.op11_warc_chain(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in common.read(spark, "/root/testdata/sf0.001", "pages").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
