"""WARC archives: exact round trip, structure and faults."""

import base64
import hashlib
import random
from pathlib import Path

import pytest

from delimlake.llm import warc


def pages_of(n=300):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "<p>", "</p>", "é", "\r\n\r\n", "WARC/1.1"]
    rows = [(i, f"http://h/{i}", " ".join(rng.choice(words) for _ in range(200)), "x") for i in range(n)]
    rows += [(1000 + i, "http://same", "copy", "x") for i in range(40)] + [(2000, None, None, "x"), (2001, "http://a\r\nb", "", "x"), (None, "u", "copy", "x"), (None, "u", "lonely", "x"), (1039, "again", "copy", "x")]
    return rows


def test_round_trip(spark):
    rows = pages_of()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    manifest = warc.write_archives(pages.repartition(3), archive_bytes=20_000)
    assert manifest.count() >= 1
    got = warc.read_archives(manifest).select("*", warc.page_of("record_id").alias("page_id"), warc.page_of("refers_to").alias("original")).collect()
    assert len(got) == len(rows)
    want = {}
    for i, _, html, _ in rows:
        want.setdefault(html or "", []).append(i)
    for r in got:
        if r["payload"] is not None:
            text = bytes(r["payload"]).decode()
            assert r["page_id"] in want[text] and r["payload_bytes"] == len(text.encode())
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    revisits = [r for r in got if r["record_type"] == "revisit"]
    assert {r["original"] for r in revisits} == {1039, 2001}
    assert len(revisits) == 40 + 1 and all(r["payload"] is None for r in revisits)
    assert sum(r["record_type"] == "response" and r["page_id"] == 1039 for r in got) == 2
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, min_bytes=3)).collect()
    assert sorted((r["payload_bytes"], r["record_type"]) for r in got) == [(2, "response"), (2, "response"), (6, "response"), (6, "revisit")]


def archive(spark, tmp_path, n=200):
    pages = spark.createDataFrame(pages_of(n)[:n], "page_id long, url string, html string, x string").coalesce(1)
    path = warc.write_archives(pages, f"file://{tmp_path}/w").first()["path"]
    return Path(path.removeprefix("file://")).read_bytes()


def test_structure_and_faults(spark, tmp_path):
    import zstandard

    data = archive(spark, tmp_path)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    records = list(warc.read_archive(data))
    assert len(records) == 200 and len({at for at, _ in records}) == 200
    assert not list(Path(tmp_path).rglob("*.part"))
    # The dictionary may itself be compressed.
    size = int.from_bytes(data[4:8], "little")
    packed = zstandard.compress(data[8 : 8 + size])
    other = data[:4] + len(packed).to_bytes(4, "little") + packed + data[8 + size :]
    assert [f for _, f in warc.read_archive(other)] == [f for _, f in records]
    with pytest.raises(ValueError, match="broken frame"):
        list(warc.read_archive(data[:-3]))
    with pytest.raises(ValueError, match="frame at"):
        list(warc.read_archive(data[: 8 + size + 40] + bytes([data[8 + size + 40] ^ 255]) + data[8 + size + 41 :]))
    with pytest.raises(ValueError, match="no frame"):
        list(warc.read_archive(data + b"junk"))
    with pytest.raises(ValueError):
        list(warc.read_archive(data[8 + size :]))  # no dictionary
    good = warc.record_bytes("urn:x", "http://u", b"body", hashlib.sha1(b"body").digest(), None)
    assert warc.parse_record(good)["payload"] == b"body"
    for bad in (good[:-1], good + b"x", good.replace(b"body", b"bodi"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Dote"), b""):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


@pytest.mark.parametrize(("n", "size"), [(1, 10), (5, 3000), (5, 200_000), (40, 60_000), (40, 0)])
def test_every_archive_has_a_dictionary(spark, tmp_path, n, size):
    """Few records, and records of which fewer than 16 make up the training bytes."""
    rng = random.Random(n)
    rows = [(i, "u", f"{i} " + " ".join(rng.choice(["<p>", "alpha", "beta", "é"]) + str(rng.randrange(99)) for _ in range(size // 6))) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    for r in manifest.collect():
        assert int.from_bytes(Path(r["path"].removeprefix("file://")).read_bytes()[:4], "little") == warc.DICTIONARY_FRAME
    got = warc.read_archives(manifest).select(warc.page_of("record_id").alias("i"), "payload").collect()
    assert sorted((r["i"], bytes(r["payload"]).decode()) for r in got) == [(i, html) for i, _, html in rows]
