"""Labelled pages without helpful markup, kinds of boilerplate apart, shared helpers, and edge cases of tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinode.llm import html, langid, licenses, suffixes, toxicity
from hinode.llm.common import Scratch, join_dealt, may_be_among, shared_dir

LONG = "The committee met for the third time this year and agreed that the bridge has to be closed until the works on its northern pier are done and paid for."
MORE = "Traffic will be led over the old road, which is narrow but sound, and the bus keeps its stops."
#: A page of bare div, each block labelled by hand: 1 is content.
LABELLED = [
    ("<div><ul><li><a href=a>", "Home page", 0), ("</a></li><li><a href=b>", "Latest news", 0), ("</a></li><li>", "Contact", 0), ("</li><li><a href=c>", "Archive of the year", 0), ("</a></li></ul></div><div><h1>", "Bridge closed", 1),
    ("</h1><p>", LONG, 1), ("</p><p>", "Who pays", 1), ("</p><p>", f"{MORE} {LONG}", 1), ("</p><p>", "Nobody knows", 1), ("</p><p>", LONG, 1), ("</p><p>", MORE, 1),
    ("</p></div><div><div><a href=x>", "More on bridges and roads of the county", 0), ("</a></div><div>", "Share", 0), ("</div><div><a href=y>", "All articles of this author here", 0), ("</a></div></div><div><a href=z>", "Imprint", 0),
]


def test_the_cut_decides_short_lines_of_a_page_without_markup():
    page = "<html><head><title>Bridge closed</title></head><body>" + "".join(a + b for a, b, _ in LABELLED) + "</a></div></body></html>"
    blocks = html.page_blocks(page)
    assert [b.text for b in blocks] == [b for _, b, _ in LABELLED] and not any(b.markup for b in blocks)
    labels = html.label_blocks(blocks, html.DEFAULT_WEIGHTS)
    assert labels == [bool(x) for *_, x in LABELLED]
    alone = html.block_costs(blocks, html.DEFAULT_WEIGHTS) > 0
    assert sum(a != b for a, b in zip(labels, alone, strict=True)) == 3  # a fifth of the blocks, all to the better


@pytest.mark.parametrize("around", ['<div class="reader-comments"><p>{}</p></div>', "<form><p>{}</p></form>", '<div id="cookie-notice">{}</div>', '<div role="navigation"><p>{}</p></div>', "<footer><p>{}</p></footer>", '<div style="display:none">{}</div>', '<article><section class="comments"><p>{}</p></section></article>'])
def test_kinds_of_boilerplate(around):
    page = f"<body><article><h1>Bridge closed</h1><p>{LONG}</p><p>{MORE}</p></article>{around.format(LONG + ' I think so too.')}</body>"
    assert html.extract_text(page) == f"Bridge closed\n{LONG}\n{MORE}"


def test_each_half_of_the_classifier_learns_from_the_other():
    pages = [f"<title>bridge number {k}</title><nav><a href=a>Home of all</a></nav><section class=zone><p>{LONG} bridge number {k}</p></section>" for k in range(30)]
    blocks = [html.page_blocks(p) for p in pages]
    seeds = [s for p, b in zip(pages, blocks, strict=True) for s in html.block_seeds(p, b)]
    assert seeds == [0, 1] * 30
    w = html.fit_block_classifier(np.concatenate([html.block_features(b) for b in blocks]), np.array(seeds))
    assert w.shape == html.DEFAULT_WEIGHTS.shape and w[html.SHAPE + 1] < html.DEFAULT_WEIGHTS[html.SHAPE + 1]


def test_pages_of_any_kind(spark):
    long_page = "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"
    rows = [(None, "u", long_page, "clash"), (None, "u", None, "clash"), (3, None, "<<<>>> & <p", "clash"), (3, None, "", None)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in got.collect()) == sorted([3000 * (len(LONG) + 1) - 1, 0, len(html.extract_text("<<<>>> & <p")), 0])
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_null_page_ids_do_not_fill_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html, "fit_block_classifier", lambda x, y: seen.append(len(y)) or html.DEFAULT_WEIGHTS)
    html.train_block_classifier(spark.createDataFrame([(None, f"<p>page {k % 7}</p>") for k in range(200)], "page_id long, html string"), sample=20)
    assert seen[0] <= 20


def test_key_filter_and_dealt_join(spark, monkeypatch):
    keys = spark.createDataFrame([(k * 7919,) for k in range(300)], "k long")
    rows = spark.range(3000).select((F.col("id") * 7919 % 100_003).alias("k"))
    wanted = {k * 7919 for k in range(300)}
    got = [r.k for r in may_be_among(rows, keys, "k").collect()]
    assert sorted(k for k in got if k in wanted) == sorted(r.k for r in rows.collect() if r.k in wanted) and len(got) < 600
    monkeypatch.setattr("hinode.llm.common.KEY_ROWS", 10)
    many = spark.createDataFrame([(k % 3, k) for k in range(100)] + [(9, 1)], "k long, x long")
    places = many.groupBy("k").agg(F.count("*").alias("places")).withColumn("y", F.col("k") * 2).where("k <> 1")
    assert sorted(map(tuple, join_dealt(many, places, ["k"], ["x"]).select("k", "x", "y").collect())) == sorted([(k % 3, k, k % 3 * 2) for k in range(100) if k % 3 != 1] + [(9, 1, 18)])


def test_scratch_tables_go(spark):
    import os

    scratch = Scratch(spark)
    a, b = scratch.keep(spark.range(3), "one"), scratch.keep(spark.range(4), "two")
    names = [p.rsplit("/", 1)[1] for _, p in scratch.paths.values()]
    scratch.clear(b)
    root = shared_dir(spark).removeprefix("file:")
    assert not os.path.exists(f"{root}/{names[0]}") and os.path.exists(f"{root}/{names[1]}") and b.count() == 4 and a is not None


def test_prime_hashes_tell_windows_apart():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(3000))
    h = suffixes.prime_hashes(np.frombuffer(data, np.uint8), 13)
    said = {}
    assert all(said.setdefault(data[k : k + 13], v) == v for k, v in enumerate(h.tolist())) and len(set(said.values())) == len(said)
    assert len(suffixes.prime_hashes(np.zeros(5, np.uint8), 9)) == 0


def test_language_and_toxicity_with_clashing_columns_and_long_texts(spark):
    words = {"aa": ["the", "and", "house", "water"], "bb": ["der", "und", "haus", "wasser"]}
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, 0.5, "x") for k, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(500, " ".join(words["bb"] * 40_000), "bb", 1.0, None), (None, None, None, None, None), (501, "", None, None, None), (7, rows[7][1], "bb", 0.1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = langid.identify_languages(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (None, 501)} == {"und"} and next(r for r in got if r.doc_id == 500).lang_pred == "bb"
    labels = spark.createDataFrame([(k, 0, int(k % 2)) for k in range(120)], "doc_id long, quality int, toxic int")
    scored = toxicity.score_toxicity(docs, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert langid.identify_languages(docs.limit(0)).collect() == [] and toxicity.score_toxicity(docs.limit(0), labels).collect() == []


def test_licenses_in_long_texts_and_beside_clashing_columns(spark):
    notice = "Released under the MIT License."
    rows = [(1, "word " * 60_000 + notice + " word" * 60_000, "clash"), (1, notice, None), (1, notice, None), (None, notice, None)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert sorted((r.doc_id is None, r.license, r.end - r.start) for r in got) == [(False, "MIT", 31)] * 3 + [(True, "MIT", 31)]
    assert {r.start for r in got} == {0, 300_000}
