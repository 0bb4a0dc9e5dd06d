"""Archives: round trips through files, other writers' frames, and damage."""

import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from tickloom.llm import warc
from tickloom.llm.common import table

SCHEMA = "page_id long, url string, html string, payload int, first string"


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) by a loop."""
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, raw in data:
        ids = [j for j, other in data if other == raw and j is not None]
        first = min(ids) if len(raw) >= 100 and ids else None
        again = first is not None and first != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_round_trip(spark, sf_dir, tmp_path):
    pages = table(spark, sf_dir, "pages")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    again = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000)).repartition(3)
    copies = rows + [(i + 1000, u, h) for i, u, h in rows]
    assert ordered(warc.round_trip(again, str(tmp_path / "a")).collect()) == ordered(plain(copies))
    whole = {(r.record_id, bytes(r.payload or b"").decode()) for r in warc.read_archives(spark, str(tmp_path / "a"), payloads=True).collect() if r.record_type == "response"}
    firsts = {i for i, *_, kind, _ in plain(copies) if kind == "response"}
    assert whole == {(f"urn:page:{i}", h or "") for i, _, h in copies if i in firsts}
    raw = next(f.read_bytes() for f in (tmp_path / "a").glob("part*"))
    assert struct.unpack("<I", raw[:4])[0] == warc.DICTIONARY, "the dictionary leads"


def test_edges(spark, tmp_path, monkeypatch):
    """Nulls, empty and very long pages, ties, repeated rows, any address, several archives a task, clashing names, ids above 2**53."""
    monkeypatch.setattr(warc, "ARCHIVE", 1 << 16)
    long, words = "ä" * 99, random.Random(1)
    rows = [(2**60 + 1, "http://a/\r\nWARC-Type: x", long), (3, None, long), (3, "", long), (None, "u", long), (5, "ü x", None), (6, "u", ""), (7, "u", ""), (8, "u", "x" * 99), (9, "u", "x" * 99)]
    rows += [(10, "u", "y" * 3_000_000), (11, "u", "y" * 3_000_000), (12, "u", "\r\n\r\nWARC/1.1\r\n" * 20)] + [(100 + i, "u", "".join(words.choices("abc \n", k=3000))) for i in range(80)]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA).repartition(2)
    assert ordered(warc.round_trip(df, str(tmp_path / "a")).collect()) == ordered(plain(rows))
    assert len(list((tmp_path / "a").glob("part*"))) > 4
    assert warc.round_trip(df.limit(0), str(tmp_path / "b")).count() == 0
    assert warc.round_trip(df.filter("page_id IS NULL"), str(tmp_path / "c")).first().record_type == "response"


@pytest.mark.parametrize("how", ["sent", "shuffled"])
def test_copies_by_either_join(spark, tmp_path, monkeypatch, how):
    monkeypatch.setattr(warc, "GROUPS_SENT", 1000 if how == "sent" else -1)
    rows = [(i, "u", f"{i % 7 if i % 3 else 0}" * 200) for i in range(200)]
    assert ordered(warc.round_trip(spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA), str(tmp_path / "a")).collect()) == ordered(plain(rows))


def one(**changes):
    body = b"<p>hello</p>"
    given = {"page_id": "1", "url": "http://a", "payload": body, "digest": hashlib.sha256(body).hexdigest(), "refers_to": None, "date": "2024-01-01T00:00:00Z"} | changes
    return warc.record_bytes(**given)


def test_validation():
    good = one()
    assert warc.parse_record(good)["problem"] is None and warc.parse_record(good)["payload"] == b"<p>hello</p>"
    for bad, said in (
        (good.replace(b"WARC/1.1", b"WARC/9.9"), "version"), (good.replace(b"WARC-Date", b"X-Date"), "warc-date"), (good + b"x", "length of the block"), (good[:-5], "length of the block"),
        (good.replace(b"hello", b"hallo"), "digest"), (one(digest="0" * 64), "digest"), (one(refers_to="7").replace(b"WARC-Refers-To", b"X-To"), "revisit"), (b"", "version"),
    ):
        assert said in warc.parse_record(bad)["problem"]
    assert warc.parse_record(good.replace(b"WARC-Type: response", b"warc-type:\r\n  response"))["record_type"] == "response"


def test_frames_of_other_writers():
    """No dictionary, a compressed dictionary, frames without sizes, skippable frames between; damage ends an archive with a row."""
    items = [one(page_id=str(i)) for i in range(50)]
    learned = zstandard.train_dictionary(1024, items * 40, k=200, d=8)
    packed = zstandard.ZstdCompressor().compress(learned.as_bytes())
    lead = struct.pack("<II", warc.DICTIONARY, len(packed)) + packed
    pack = zstandard.ZstdCompressor(dict_data=learned, write_content_size=False)
    raw = lead + b"".join(pack.compress(x) + struct.pack("<II", warc.SKIPPABLE + 3, 5) + b"other" for x in items)
    assert [(r, p) for _, r, p in warc.frames(raw)] == [(x, None) for x in items]
    alone = b"".join(zstandard.ZstdCompressor().compress(x) for x in items)
    assert [r for _, r, _ in warc.frames(alone)] == items and list(warc.frames(b"")) == []
    assert [p for *_, p in warc.frames(alone[:-7])][-1] == "frame is cut off"
    assert [p for *_, p in warc.frames(alone + b"abc")][-1] == "rest is shorter than a frame"
    assert "cannot be decoded" in [p for *_, p in warc.frames(alone + b"not a frame at all")][-1]
    assert any(p for *_, p in warc.frames(raw[len(lead) :])), "frames need their dictionary"


def test_damage_stops_the_query(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40, 0, "") for i in range(30)], SCHEMA).coalesce(1)
    warc.round_trip(pages, str(tmp_path / "a")).count()
    file = next((tmp_path / "a").glob("part*"))
    raw = bytearray(file.read_bytes())
    raw[-60] ^= 0xFF
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.zst").write_bytes(raw)
    found = warc.read_archives(spark, str(tmp_path / "b")).collect()
    assert sum(r.problem is not None for r in found) == 1 and sum(r.problem is None for r in found) >= 28
