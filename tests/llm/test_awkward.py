"""Broken markup and long runs: results as of short ones, and work linear in the text."""

import time

import pytest
from pyspark.sql import functions as F

from outspan.llm.pii import _automaton, find_pii, find_spans, octet
from outspan.llm.site_style_tree import DEPTH, blocks_of, extract_main_text, main_text

PAGES = {
    "tags without an end": "<div " * 200_000,
    "open quotes": "<a \"'" * 200_000 + ">",
    "nothing closed": "<div>a " * 140_000,
    "closed in vain": "<section><td>" + "<div>" * 80_000 + "</section>" * 80_000,
    "signs": "<" * 1_000_000,
    "attributes": "<div " + "hidden " * 140_000 + ">x",
    "comments": "<!--" * 250_000,
}
TEXTS = {
    "octets": "1.1.1." + "1" * 1_000_000,
    "zeros": "0" * 999_990 + ".1.1.1",
    "parts": "1." * 500_000,
    "cues": "token=" * 170_000,
    "quoted cues": 'token="' * 140_000,
    "signs": "a@" * 500_000,
    "schemes": "a://" * 250_000,
    "plus": "+1(" * 300_000,
    "card": "1 " * 500_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_broken_pages_are_linear(name):
    began = time.process_time()
    main_text(PAGES[name], frozenset([1]))
    assert time.process_time() - began < 8  # minutes to hours if each sign looked through the page


@pytest.mark.parametrize("name", TEXTS)
def test_long_runs_are_linear(name):
    began = time.process_time()
    find_spans(TEXTS[name], _automaton())
    assert time.process_time() - began < 8


def test_octets():
    assert [octet(x) for x in ("0", "255", "256", "000255", "0" * 5000, "9" * 5000, "99", "1000")] == [True, True, False, True, True, False, True, False]
    a = _automaton()
    assert find_spans("1.1.1." + "0" * 5000 + "9", a) == [(0, 5007, "ip")]
    assert not [s for s in find_spans("1.1.1." + "1" * 5000, a) if s[2] == "ip"]
    assert find_spans("1" * 6000, a) == [] and find_spans("+1" + "2" * 5000, a) == []


def test_cues_without_digits():
    """A cue inside a value without a digit starts no value of its own, but one after it does."""
    a = _automaton()
    assert find_spans("token=abcdefghijkl-token=abcdefghijkl", a) == []
    assert find_spans('token=abcdefghijkl-token="abcdefghijk1"', a) == [(26, 38, "account")]
    assert find_spans('secret="abcdefghijkl" token=abcdefghijk1', a) == [(28, 40, "account")]


def test_open_quotes_and_nesting():
    assert main_text('<p title="a>b">x</p><p title="open>y</p>', frozenset()) == "x y"
    assert main_text("<p>a < b</p><div", frozenset()) == "a < b"
    blocks, root = blocks_of("<div>a" * 200)
    assert len(blocks) == 200 and max(b[3].depth for b in blocks) == DEPTH and root.below == ["div"]


def test_rows_of_broken_pages(spark):
    rows = [(i, "//h/x", x) for i, x in enumerate(("<div>a " * 3000, "<div " * 3000, "<a \"'" * 3000, "<p>kept</p>"))]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: " ".join(["a"] * 3000), 1: "", 2: "", 3: "kept"}
    text = spark.createDataFrame([(x,) for x in TEXTS.values()], "text string")
    assert find_pii(text).filter(F.size("pii_spans") >= 0).count() == len(TEXTS)
