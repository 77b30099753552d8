"""Pipeline stages against brute force; columns that clash, empty tables and
long texts; pages, packing and the stated odds."""

import collections
import math
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_registered import DOCUMENTS, jaccard_components, prose, texts
from tokenizers import Tokenizer

import corpus_pipeline
from recall_engine.llm import html, near_dedup, neighbours, packing, quality, secrets, stage, substring_dedup, suffix_dedup, token_files, tokenize

CLASHING = "key string, id string, row string, spans string, cuts string, __key string, q_kept boolean, kept string, start int, label int, h long"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents whose other columns bear the names that operators use inside."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = spark.createDataFrame(DOCUMENTS, "doc_id long, text string")
    return rows.select("doc_id", "text", F.lit(0).cast("long").alias("n_chars"), *(F.lit("1").cast(CLASHING.split(", ")[k].split()[1]).alias(c) for k, c in enumerate(names)))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def got(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stage_quality(spark, docs, sf):
    out = corpus_pipeline.keep_good(spark, docs, sf)
    model = quality.train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = collections.Counter(r.doc_id for r in quality.judge_quality(docs, model).where("kept").collect())
    assert collections.Counter(r.doc_id for r in out.collect()) == kept and out.columns == docs.columns
    assert set(got(out)) <= set(DOCUMENTS) and 7 not in kept and 8 not in kept


def test_stage_near_dedup(spark, docs, sf):
    out = corpus_pipeline.keep_one(spark, docs, sf)
    found = jaccard_components(5, 80, texts())
    kept = {i for i, n, c in found if i == c or not n}
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == sorted(kept)
    assert out.columns == docs.columns and set(got(out)) <= set(DOCUMENTS)


def test_stage_suffix_dedup(spark, docs, sf):
    n = corpus_pipeline.REPEAT_BYTES
    raw = [(t or "").encode() for _, t in DOCUMENTS]
    seen = collections.Counter(hash(b[s : s + n]) for b in raw for s in range(len(b) - n + 1))
    want = []
    for (i, t), b in zip(DOCUMENTS, raw, strict=True):
        edge = np.zeros(len(b) + 1, np.int64)
        at = np.array([s for s in range(len(b) - n + 1) if seen[hash(b[s : s + n])] > 1], np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        left = np.frombuffer(b, np.uint8)[np.cumsum(edge)[:-1] == 0].tobytes().decode("utf-8", "ignore")
        want.append((i, t if t is None else left))
    out = corpus_pipeline.cut_repeats(spark, docs, sf)
    assert got(out) == sorted(want, key=str) and out.columns == docs.columns
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    # planted passages of 55 and more words go, wherever they stand
    shared = DOCUMENTS[5][1].split()[:55]
    assert not any(" ".join(shared[:50]) in (r.text or "") for r in out.collect())


def test_stage_secrets(spark, docs, sf):
    out = corpus_pipeline.hide_secrets(spark, docs, sf)
    spans = {r.doc_id: r.found for r in secrets.scan_secrets(docs).collect()}
    want = []
    for i, t in DOCUMENTS:
        merged = []
        for x in sorted(spans[i], key=lambda x: (x.start, x.end)):
            if merged and x.start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], x.end)
            else:
                merged.append([x.start, x.end])
        for a, b in reversed(merged):
            t = t[:a] + "[SECRET]" + t[b:]
        want.append((i, t))
    assert got(out) == sorted(want, key=str) and out.columns == docs.columns
    assert not any(re.search("AKIA[A-Z0-9]{16}", r.text or "") for r in out.collect())


def test_stage_packing(spark, docs, sf):
    out = corpus_pipeline.pack_sequences(spark, docs, sf).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in DOCUMENTS[:20]:
        if DOCUMENTS.count((i, t)) == 1 and i is not None:
            ids = [x for p in out[out.doc_id == i].sort_values("piece").ids for x in p]
            assert ids == [*plain.encode(t or "", add_special_tokens=False).ids, 2]
    assert (out.groupby("sequence_id").length.sum() <= 1024).all()


def test_pipeline_runs_the_stages(spark, tmp_path, sf):
    path = str(tmp_path)
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in DOCUMENTS], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    want = rows
    for _, step in corpus_pipeline.STAGES:
        want = step(spark, want, path)
    columns = ["doc_id", "piece", "start", "length", "ids"]
    out = corpus_pipeline.run(spark, path)
    assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect())) and out.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "secret scans", "best-fit packing"]


def test_empty_tables_and_clashing_columns(spark, docs):
    none = docs.limit(0)
    vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert secrets.scan_secrets(none).count() == 0 and secrets.redact(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0 and suffix_dedup.cut_bytes(suffix_dedup.suffix_dedup(none)).count() == 0
    assert near_dedup.keep_one_each(none).count() == 0 and near_dedup.near_duplicates(none).count() == 0
    assert quality.keep_good(none, None).count() == 0 and quality.train_quality(none, none.select("doc_id", F.lit(1).alias("quality"))) is None
    assert substring_dedup.cut_words(substring_dedup.substring_dedup(none)).count() == 0
    assert tokenize.decode_ranks(tokenize.encode_ranks(none, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).count() == 0
    assert packing.pack(packing.cut_pieces(none, vocabulary, 2)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string, key string, removed string")
    assert html.extract_main_text(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, bucket string, subs int")
    assert neighbours.nearest(vectors, vectors).count() == 0
    n = len(DOCUMENTS)
    assert near_dedup.near_duplicates(docs).count() == secrets.scan_secrets(docs).count() == quality.judge_quality(docs, None).count() == suffix_dedup.suffix_dedup(docs).count() == substring_dedup.substring_dedup(docs).count() == n
    assert tokenize.encode_ranks(docs, ranks, public_tokenizers.PATTERN).columns == [*docs.columns, "ids"]
    one = spark.createDataFrame([(1, "u", "<p>a</p>", "k", "r", "c", 1)] * 2, "page_id long, url string, html string, key string, removed string, content string, pages int")
    assert [tuple(r) for r in html.extract_main_text(one).collect()] == [(1, "u", "a")] * 2
    same = spark.createDataFrame([(i, [float(i), 1.0], "b", 3, 1, 2) for i in range(4)], "vec_id long, embedding array<float>, bucket string, subs int, dim int, table int")
    assert neighbours.nearest(same, same.where("vec_id = 0")).count() == 3


def test_site_templates_act(spark):
    """Subtrees on many pages of a host go though no name tells of them; with the
    step left out they would stay, and what a few pages share stays."""
    page = lambda i: f"<body><div class=x1><p>Our shop sells <b>things</b></p></div><section><p>text number {prose(12, i)}</p></section><div><p>shared by {i % 8}</p></div></body>"
    rows = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(40)] + [(100 + i, "http://h.example/c", page(0)) for i in range(30)], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html.extract_main_text(rows).collect()}
    assert out == {**{i: f"text number {prose(12, i)} shared by {i % 8}" for i in range(40)}, **{100 + i: f"text number {prose(12, 0)} shared by 0" for i in range(30)}}
    kept = {r.page_id: r.text for r in html.extract_main_text(rows, least_pages=1000).collect()}
    assert all(t.startswith("Our shop sells things") for t in kept.values())


def test_article_keeps_its_own_words(spark):
    cases = {
        "<article><h2 id='search'>Find it</h2><p class='notice-period'>two weeks</p><p class='related work'>cited</p><section id='related-work'>more</section></article>": "Find it two weeks cited more",
        "<article><header><h1>T</h1></header><div class='comments'>no</div><ul class='share x'><li>no</ul><p>a&amp;b &#233;&nbsp;c</article><footer>f</footer>": "T a&b é c",
        "<nav>n</nav><main><p>m<aside>x</aside></main>": "m",
        "<div class='Content'><p>c</div><div class='cookie-notice'>no</div>": "c",
        "<article>a<table><tr><td>1<td>2<tr><th>3</table><dl><dt>t<dd>d</dl></article>": "a 1 2 3 t d",
        "<article>x <b>y</b>z</u></article></div>w": "x yz",
    }
    rows = spark.createDataFrame([(k, "u", x) for k, x in enumerate(cases)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract_main_text(rows).collect()} == dict(enumerate(cases.values()))


@pytest.mark.parametrize("broken", ["<b>{n}</u>", "<a \"{n}", '<a ">"{n}', "<a {n}", "<!x {n}", "<script></script {n}", "<td><tr><b>{n}<td/>", "<p><table><b>{n}<hr>"])
def test_parsing_takes_time_in_proportion(broken):
    first, last = broken.split("{n}")
    took = []
    for n in (20_000, 160_000):
        text = first * n + last * n
        began = time.perf_counter()
        root = html.parse(text)
        html.subtree_hashes(root)
        html.text_of(html.main_elements(root))
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 1  # eight times the text; a quadratic parse takes 64 times as long


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_packing_under_every_constraint(measure):
    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(1, 6, 3000), rng.integers(1, 1025, 300)])
    how = packing.Capacity(measure=measure, documents=40, attention=260)
    bins, offsets = packing.best_fit(lengths, how)
    needs = how.needs(lengths)
    sums = np.stack([np.bincount(bins, weights=x) for x in needs])
    assert (sums <= np.array([how.tokens, how.documents, how.attention])[:, None]).all() and sums[1].max() == 40
    for b in range(bins.max() + 1):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert (offsets[mine] == np.cumsum(lengths[mine]) - lengths[mine]).all()
    # each constraint decides: without it some bin breaks it
    for k, loose in ((1, packing.Capacity(measure=measure, attention=260)), (2, packing.Capacity(measure=measure, documents=40, attention=10**6))):
        other, _ = packing.best_fit(lengths, loose)
        assert np.bincount(other, weights=needs[k]).max() > (how.documents, how.attention)[k - 1]


def test_packing_selects_by_the_measure():
    """A hand-made choice among three open bins: every weight can turn it."""
    how = packing.Capacity(tokens=100, documents=10, attention=100, tile=10, weights=(1, 0, 0))
    lengths = np.array([70, 60, 30])
    assert packing.best_fit(lengths, how)[0].tolist() == [0, 1, 0]
    by_attention = packing.Capacity(tokens=100, documents=10, attention=70, tile=10, weights=(0, 0, 1), measure="dot")
    assert packing.best_fit(lengths, by_attention)[0].tolist() == [0, 1, 1]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), how)
    assert packing.best_fit(np.zeros(0, np.int64), how)[0].tolist() == []


def test_stated_odds():
    """The chances that the docstring of MinHash gives, for a pair at 80 %."""
    how = near_dedup.MinHash()
    assert (1 - 0.8**how.rows) ** how.bands < 5e-7
    below = sum(math.comb(how.sketch, k) * 0.8**k * 0.2 ** (how.sketch - k) for k in range(how.sketch_least))
    assert below < 1e-8
    line = math.ceil(how.low * how.low_percent / 100)
    assert sum(math.exp(math.lgamma(how.low + 1) - math.lgamma(k + 1) - math.lgamma(how.low - k + 1) + k * math.log(0.8) + (how.low - k) * math.log(0.2)) for k in range(line)) < 1e-9


def test_shared_folder(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match=re.escape("spark.checkpoint.dir")):
        stage.shared_dir(Cluster)
    table = stage.written(spark.range(3), "t")
    assert table.count() == 3
    stage.discard(table, None)
    with pytest.raises(Exception, match="(?i)not.*exist|not_found|FAILED_READ"):
        spark.read.parquet(table.written_to)


def test_join_hot(spark):
    rows = spark.range(3_000).selectExpr("id", "IF(id % 3 = 0, id, 7) AS k")
    right = spark.range(3_000).selectExpr("id AS k", "id * 2 AS twice")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(stage.join_hot(rows, right, ["k"], counts, 3_000).collect()) == sorted(rows.join(right, "k").select("k", "id", "twice").collect())


def test_token_files_are_in_order_over_parts(spark, tmp_path):
    docs = spark.range(500).selectExpr("500 - id AS doc_id", "concat('text ', id) AS text", "id AS part", "id AS pos").repartition(5)
    token_files.write_token_ids(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"), 1)
    rows = token_files.token_offsets(token_files.read_token_ids(spark, str(tmp_path / "t"))).orderBy("part", "pos").collect()
    assert [r.doc_id for r in rows] == list(range(1, 501)) and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()


def test_names_decide_only_where_they_say_nothing_else():
    def text(page):
        return html.text_of(html.main_elements(html.parse(page)))

    body = "<article><h1>Head</h1><p>One.</p>{}<p>Two.</p></article>"
    for kept in ("<div class='share price'><p>The share price fell.</p></div>", "<section class='social history'>The share price fell.</section>", "<div class='banner-bearers'>The share price fell.</div>"):
        assert text(body.format(kept)) == "Head One. The share price fell. Two."
    for gone in ("<div class=share>no</div>", "<div class='ad container'>no</div>", "<section class='comments' id=c>no</section>", "<div role=navigation class='my own'>no</div>", "<aside>no</aside>", "<form class='x'>no</form>"):
        assert text(body.format(gone)) == "Head One. Two."
    assert text("<body><p class='notice-period'>The notice period is long.</p><p class=ad>no</p><div class='ad-box'>no</div></body>") == "The notice period is long."
