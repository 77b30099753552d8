"""WARC archives: exact round trips, revisits, ranges, false magic and damage."""

import base64
import gzip
import hashlib
import io
import random

import pytest

from recall_engine.llm import warc
from recall_engine.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, payload binary, digest string"
R = random.Random(3)
LONG = "".join(R.choices("abcdefghij <>é", k=900_000))
ROWS = [
    (3, "http://a/3", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, "http://a/2\r\nX-Evil: 1", "<p>same</p>"), (4, "u", None), (5, "u", ""), (6, None, "WARC/1.1\r\n\r\n\r\n\r\n"),
    (7, "v", LONG), (8, "w", LONG), (9, "x", "é中😀\r\n\r\nbody"), (10, "y", "only"), (10, "y", "only"), (10, "y", "only"), (10, "z", "only"), (None, "n", "null id"), (None, "n", "<p>null first</p>"), (11, "n", "<p>null first</p>"),
    *((20 + i, f"http://h/{i}", f"<html>{'x' * (i % 50)}{i // 3}</html>") for i in range(200)),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to), one response for rows alike."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    out, first = [], {}
    for i, r in enumerate(sorted(rows, key=key)):
        html = r[2] or ""
        size = len(html.encode())
        n, leader = first.setdefault(html, (i, r)) if size >= least else (i, r)
        out.append((r[0], size, digest(html), "response" if n == i else "revisit", None if n == i else leader[0]))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, b"x", "y") for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize(("least", "split", "file_bytes"), [(0, 4096, 1 << 30), (0, 50_000, 20_000), (12, 16 << 20, 1 << 30)])
def test_round_trip(spark, tmp_path, least, split, file_bytes):
    manifest = warc.write_warc(pages(spark, ROWS), f"file:{tmp_path}/a", least, file_bytes=file_bytes)
    assert manifest.count() >= (4 if file_bytes < 1 << 30 else 1)
    read = warc.read_warc(manifest, split).where("record_type <> 'warcinfo'").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str) == brute(ROWS, least)
    assert all(r.intact for r in read if r.record_type == "response") and all(r.payload is None for r in read if r.record_type == "revisit")
    htmls = {}
    for i, _, h in ROWS:
        htmls.setdefault(i, set()).add((h or "").encode())
    assert all(bytes(r.payload) in htmls[r.page_id] for r in read if r.record_type == "response")
    ids = {r.record_id: r for r in read}
    assert len(ids) == len(ROWS) and all(ids[r.refers_to_id].payload_digest == r.payload_digest for r in read if r.record_type == "revisit")


def test_files_found_below_a_path(spark, tmp_path):
    warc.write_warc(pages(spark, ROWS), f"{tmp_path}/a")
    found = warc.list_files(spark, f"{tmp_path}/a")
    assert warc.read_warc(found, 10_000).where("record_type <> 'warcinfo'").count() == len(ROWS)


def test_empty_table(spark, tmp_path):
    manifest = warc.write_warc(pages(spark, []), f"{tmp_path}/a")
    assert manifest.count() == 0 and warc.read_warc(manifest).count() == 0


def archive(n, seed=1, level=6):
    """Records of every kind of payload, some with gzip magic or a nested member
    in bytes that deflate stores as they are."""
    r, out = random.Random(seed), []
    for i in range(n):
        noise = r.randbytes(r.choice([0, 10, 3000]))
        nested = gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n") if i % 3 == 0 else b""
        body = noise + warc.MAGIC * (i % 4) + nested + noise
        out.append(gzip.compress(warc._record("resource", [("X-Page-Id", str(i))], body), level))
    return out


class Counted(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("split", [1, 7, 64, 1000, 5000, 10**6])
def test_ranges_own_each_record_once(split, level):
    parts = archive(40, 2, level)
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    source = Counted(whole)
    if split < 64:  # every range of a few bytes, in the first records alone
        whole = b"".join(parts[:4])
        source, starts, parts = Counted(whole), starts[:4], parts[:4]
    got = [(at, content) for start in range(0, len(whole), split) for at, content in warc.members(source, start, start + split, len(whole))]
    assert got == [(at, gzip.decompress(p)) for at, p in zip(starts, parts, strict=True)]


def test_damage():
    parts = archive(12)
    whole = bytearray(b"".join(parts))
    at = sum(map(len, parts[:5])) + 30
    whole[at : at + 4] = b"\xff\xff\xff\xff"
    source = Counted(bytes(whole))
    with pytest.raises(ValueError, match="no WARC member"):
        list(warc.members(source, 0, len(whole), len(whole)))
    kept = [c for _, c in warc.members(source, 0, len(whole), len(whole), skip_damaged=True)]
    # the member before the damage is only sure to end where the next one begins, which still has its magic
    assert kept == [gzip.decompress(p) for i, p in enumerate(parts) if i != 5]
    cut = bytes(b"".join(parts))[:-5]
    with pytest.raises(ValueError, match="no WARC member"):
        list(warc.members(Counted(cut), 0, len(cut), len(cut)))


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_warc"](spark, sf).collect()), key=str) == brute(rows)
