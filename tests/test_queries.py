import hashlib
import re

import duckdb
import pytest

from recall_engine.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count()


def test_normalize_text_all(spark, tmp_path):
    """A row for every document, equal to Python's case folding and the Unicode class of white space."""
    awkward = [(-1, None), (-2, ""), (-3, " \u00c9T\u00c9\u00a0\u2003\u3000Stra\u00dfe\u0085\u2028\u0130X \u039f\u03a3 "), (-4, "a\x0b\x1cb\u200bC\ufeff")]
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(awkward, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    space = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    want = [(i, None if t is None else hashlib.md5(re.sub(space, " ", t.lower().strip(" ")).encode()).hexdigest()) for i, t in docs]
    got = [tuple(r) for r in QUERIES["normalize_text_all"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and any(not (t or "").isascii() for _, t in docs)


def tokens(text):
    return -(-len(text) // 4)


def packed(lines, most, overlap):
    """(first, last) of chunks: a line that would exceed ``most`` begins a new
    one, with as many lines before it again as hold ``overlap``."""
    chunks, mine, size = [], [], 0
    for k, line in enumerate(lines, 1):
        cost = tokens(line + "\n")
        if mine and size + cost > most:
            chunks.append((mine[0], mine[-1]))
            again, size = [], 0
            while mine and size < overlap:
                again.insert(0, mine.pop())
                size += tokens(lines[again[0] - 1] + "\n")
            mine = again
        mine.append(k)
        size += cost
    return [*chunks, (mine[0], mine[-1])]


def test_line_chunks_by_hand(spark):
    want = set()
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        lines = (d.text or "").split("\n")
        for a, b in packed(lines, 300, 40):
            text = "\n".join(lines[a - 1 : b])
            want.add((str(d.doc_id), a, b, tokens(text), hashlib.sha256(f"{d.doc_id}:{a}:{text}".encode()).hexdigest()[:16]))
    assert {tuple(r) for r in QUERIES["line_chunks"](spark, SF).collect()} == want


def test_page_chunks_by_hand(spark):
    """A page is cut as one file, what is longer than 625 tokens once more, and a
    chunk's id is that of its lines, or of a part of one line."""
    pages = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        pages.setdefault(re.sub(r"^[a-z]+://|[?#].*$", "", r.url), []).append(r.html)
    rows = QUERIES["page_chunks"](spark, SF).collect()
    assert {r.file_path for r in rows} == set(pages) and all(r.token_count <= 625 for r in rows)
    for r in rows:
        parts = []
        for html in pages[r.file_path]:
            whole = "\n".join(html.split("\n")[r.start_line - 1 : r.end_line])
            parts += [whole] + [whole[k : k + 2500] for k in range(0, len(whole), 2500) if r.start_line == r.end_line]
        assert r.id in {hashlib.sha256(f"{r.file_path}:{r.start_line}:{x}".encode()).hexdigest()[:16] for x in parts}
    for path, htmls in pages.items():
        assert sum(4 * r.token_count for r in rows if r.file_path == path) >= sum(len(h) - h.count("\n") for h in htmls)


def test_bin_pack_by_hand(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, tokens(r.text or "") + 20))
    want = set()
    for conv, rows_ in turns.items():
        size = batch = 0
        for turn, cost in sorted(rows_):
            if size and size + cost > 400:
                size, batch = 0, batch + 1
            size += cost
            want.add((conv, turn, batch))
    assert {tuple(r) for r in QUERIES["bin_pack"](spark, SF).collect()} == want


def test_summaries_by_hand(spark):
    """Sources within the budget keep their texts; the others shrink to it."""
    docs = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        docs.setdefault(r.source, []).append(len(r.text or ""))
    got = {}
    for r in QUERIES["summaries"](spark, SF).collect():
        got.setdefault(r.project_id, []).append(r.n_chars)
    assert set(got) == set(docs)
    for source, sizes in docs.items():
        if sum(-(-n // 4) for n in sizes) <= 20_000:
            assert sorted(got[source]) == sorted(sizes)
        else:
            assert sum(-(-n // 4) for n in got[source]) <= 20_000 and min(got[source]) > 0
