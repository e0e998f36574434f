"""Training-data operators on inputs that a cap, a lost end tag or a long text would cut or stop."""

import time

from quillmark.llm import html, quality


def test_every_stratum_gets_its_cutoff(spark):
    names = [f"l{i:02d}" for i in range(70)]
    zeros = [f"0L AS {c}" for c in quality.COUNTS if c not in ("n_words", "n_bang")]
    rows = spark.range(70 * 600).selectExpr("id AS doc_id", "concat('l', lpad(cast(id div 600 AS string), 2, '0')) AS lang", "100L AS n_words", "if(id % 600 < 20, 180L, 0L) AS n_bang", *zeros)
    labels = spark.range(70 * 600).selectExpr("id AS doc_id", "if(id % 600 < 20, 0, 1) AS quality")
    cutoffs = quality.thresholds(rows, labels, "quality", "lang", risk=0.2)
    assert sorted(r["__stratum"] for r in cutoffs.collect()) == names
    found = quality.judged(rows, cutoffs, "lang").groupBy("lang").agg({"doc_id": "count"}).count()
    assert found == 70 and quality.judged(rows, cutoffs, "lang").where("__rejected").count() == 70 * 20


def test_head_may_stay_open():
    for start in ("<body>", "", "<p>"):
        page = f"<html><head><title>no</title><meta charset=utf-8>{start}Loose words here<article><p>The text.</p></article></html>"
        assert [b.text for b in html.blocks_of(page)] == ["Loose words here", "The text."]
    assert html.blocks_of("<head><noscript>no</noscript></head>") == []


def test_hidden_elements_nest_and_end_at_blocks():
    assert [b.text for b in html.blocks_of("<p>a <svg><svg><text>no</text></svg><title>no</title>no</svg>b</p>")] == ["a b"]
    assert [b.text for b in html.blocks_of("<p>one <math><mi>x<p>two</p><div>three</div>")] == ["one", "two", "three"]
    assert [b.text for b in html.blocks_of("<select><option>no<option>no</select><p>yes")] == ["yes"]


def test_long_blocks_are_read_whole():
    far = html.blocks_of("<p>" + "x" * 5000 + "&nbsp;cookie</p>")
    assert "cue cookie" in html.describe(far)[0]


def test_pages_that_never_close_are_scanned_once():
    began = time.time()
    assert [len(b.text) for b in html.blocks_of("<a " * 60_000)] == [3 * 60_000 - 1]
    assert html.blocks_of("<b x=\"'\" '" * 20_000 + "<p>end") != []
    assert len(html.describe(html.blocks_of("<div>w" * 8_000))) == 8_000
    assert html.blocks_of("<svg>" * 20_000 + "</p>" * 10) == [] and html.blocks_of("<title>" * 20_000) == []
    assert time.time() - began < 20
