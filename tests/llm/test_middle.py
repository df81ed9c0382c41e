"""Fill-in-middle: units, cuts, forms and the way back, against a plain reference."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from tickerloom.llm import middle


def by_hand(key: str, text: str):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y = h1 % (n + 1), h2 % (n + 1)
    before, inside, after = ("".join(p) for p in (units[:min(x, y)], units[min(x, y):max(x, y)], units[max(x, y):]))
    if h4 % 100 < 20:
        return n, "spm", len(before), len(inside), "<S>" + after + "<P>" + before + "<M>" + inside
    return n, "psm", len(before), len(inside), "<P>" + before + "<S>" + after + "<M>" + inside


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10**12), st.text(st.sampled_from("abZ <>PSM\n\0é漢7𝒳"), max_size=40), st.integers(1, 9))
def test_equals_plain_reference_in_pieces_of_any_size(key, text, piece):
    assert middle.transform(str(key), text, piece) == by_hand(str(key), text)


def test_one_letter_run_longer_than_a_piece():
    text = "x" * 50 + "12" + "y" * 30
    assert list(middle.unit_ends(text, 7)) == [50, 51, 52, 82]


def test_text_beyond_a_piece(prose_of):
    text = prose_of(5, 200_000) + " <<S>"
    assert len(text) > middle.PIECE
    assert [int(e) for e in middle.unit_ends(text)] == [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]


def test_hard_rows_round_trip(spark, hard_docs):
    clash = hard_docs.withColumnRenamed("n", "form")
    rows = middle.fill_in_middle(clash, keep=["doc_id", "text", "form", "source"]).withColumn("back", middle.restore()).collect()
    assert len(rows) == hard_docs.count() and {r["source"] for r in rows} == {None}
    for r in rows:
        text = r["text"] or ""
        assert r["back"] == text
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_hand(key, text)


def test_marks_at_part_ends_come_back(spark):
    rows = [(i, t) for i in range(60) for t in ("a<b<", "<", "<S", "x<P y<M z<S", "S>M>P>", "<P>", "a <M> b", "<<S")]
    out = middle.fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=["doc_id", "text"])
    found = out.withColumn("back", middle.restore()).collect()
    assert all(r["back"] == r["text"] for r in found) and {r["form"] for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("keep", [[], ["doc_id"], ["lang", "doc_id"]])
def test_no_rows(no_docs, keep):
    out = middle.fill_in_middle(no_docs, keep=keep)
    assert out.columns == [*keep, *middle.RESULTS] and out.count() == 0
