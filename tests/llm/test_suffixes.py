"""Repeated byte passages against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tickerloom.llm import queries, suffixes


def by_hand(rows, width):
    """(id, removed spans, rest) of each (id, text), as a sorted list."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in data:
        for k in range(len(raw) - width + 1 if i is not None else 0):
            w = raw[k:k + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, raw in data:
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - width + 1 if i is not None else 0):
            if first[raw[k:k + width]] < i:
                gone[k + 1:k + width + 1] = True
        starts, ends = np.flatnonzero(gone[1:] & ~gone[:-1]).tolist(), np.flatnonzero(gone[:-1] & ~gone[1:]).tolist()
        out.append((i, len(raw), int(gone.sum()), starts, ends, bytes(b for b, g in zip(raw, gone[1:]) if not g)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["span_starts"], r["span_ends"], bytes(r["clean_bytes"])) for r in df.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), min_size=3, max_size=25), min_size=1, max_size=8), st.integers(2, 6))
def test_interval_expansion_finds_equal_windows(texts, width):
    parts = [t.encode() for t in texts if len(t) >= width]
    if not parts:
        return
    sizes, ids = np.array([len(p) for p in parts]), np.arange(len(parts))[::-1].copy()
    segment, first = suffixes.first_ids(np.frombuffer(b"".join(parts), np.uint8), sizes, ids, width)
    least = {}
    for s, p in enumerate(parts):
        for k in range(len(p) - width + 1):
            w = p[k:k + width]
            least[w] = min(least.get(w, 99), ids[s])
    expected = [(s, least[p[k:k + width]]) for s, p in enumerate(parts) for k in range(len(p) - width + 1)]
    assert list(zip(segment.tolist(), first.tolist())) == expected


@pytest.mark.parametrize("most", [64, 200, 1 << 20])
def test_pieces_hold_every_window_once(most):
    rng = np.random.default_rng(most)
    sizes = [0, 3, 49, 50, 51, 400, 1000, 70, 0, 120]
    offsets = np.append(0, np.cumsum(sizes))
    data = rng.integers(97, 100, offsets[-1]).astype(np.uint8)
    seen, anchors = [], {}
    for piece in suffixes.pieces(data, offsets, 50, most):
        for a, b, row, anchor in zip(piece.first, piece.last, piece.row, piece.anchor, strict=True):
            for k in range(a + piece.base, b + piece.base + 1):
                seen.append((row, k))
                anchors.setdefault(data[k:k + 50].tobytes(), set()).add(anchor)
    assert sorted(seen) == [(r, k) for r in range(len(sizes)) for k in range(offsets[r], offsets[r + 1] - 49)]
    assert all(len(a) == 1 for a in anchors.values())


def passages(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh éß漢") for _ in range(3000))
    rows = []
    for i in range(60):
        a, b = rng.randrange(2500), rng.randrange(2500)
        mine = "".join(rng.choice("xyz uvw") for _ in range(rng.randrange(200)))
        rows.append((rng.randrange(40), base[a:a + rng.randrange(300)] + mine + base[b:b + rng.randrange(120)]))
    return rows


@pytest.mark.parametrize("width, hot", [(50, 1 << 16), (50, 2), (20, 5), (8, 30)])
def test_equals_plain_reference(spark, monkeypatch, width, hot):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3000)  # many buckets and shards
    monkeypatch.setattr(suffixes, "SHARD_ENTRIES", 100)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 5000)
    rows = passages(width)
    monkeypatch.setattr(suffixes, "HOT", hot)  # anchors with more places are dealt by windows
    rows += [(100 + i, " " * 70 + str(i) + " " * 90 + "-" * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = found(suffixes.remove_repeats(df, width))
    assert got == by_hand(rows, width) and sum(r[2] for r in got) > 0


def test_hot_anchors_are_dealt_by_windows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 4096)
    # One gram of 16 blanks stands in more places than HOT, with different bytes on both sides.
    rng = random.Random(2)
    letters = "abcdefghij"
    rows = [(i, "".join("".join(rng.choice(letters) for _ in range(6)) + " " * 40 + "".join(rng.choice(letters) for _ in range(9)) for _ in range(40)))
            for i in range(260)]
    assert 260 * 40 > suffixes.HOT
    rows += [(1000 + i, rows[i][1][100:400]) for i in range(20)]
    got = found(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == by_hand(rows, 50) and sum(r[2] for r in got) >= 20 * 300


def test_hard_rows_and_clashing_columns(spark, hard_docs):
    out = suffixes.remove_repeats(hard_docs, keep=["source", "bucket", "key", "clean_bytes", "n_removed"])
    assert out.columns == ["doc_id", "source", "bucket", "key", *suffixes.RESULTS]
    assert found(out) == by_hand([(r["doc_id"], r["text"]) for r in hard_docs.collect()], 50)


def test_a_third_of_the_rows_on_one_id_or_without_one(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20_000)
    base = passages(7)
    text = "".join(t for _, t in base)[:2000]
    rows = [(i + 100, t) for i, t in base] + [(50, text)] * 60 + [(None, text)] * 60 + [(51, t + str(k)) for k, (_, t) in enumerate(base)]
    got = found(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == by_hand(rows, 50)
    assert [r[2] for r in got if r[0] is None] == [0] * 60


def test_text_beyond_a_piece(spark, prose_of):
    long = prose_of(3, 150_000)
    assert len(long) > suffixes.PIECE_BYTES
    rows = [(1, long[1_040_000:1_060_000]), (2, long), (3, long[7:]), (4, "x" * 2_100_000), (5, "y" + "x" * 60)]
    got = {r[0]: r for r in found(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")))}
    assert got[1][2] == 0 and got[4][2] == 0 and got[5][2:5] == (60, [1], [61])
    assert got[2][3:5] == ([1_040_000], [1_060_000]) and got[2][5] == (long[:1_040_000] + long[1_060_000:]).encode()
    assert got[3][2] == len(long) - 7


def test_no_rows(no_docs):
    out = suffixes.remove_repeats(no_docs, keep=["lang"])
    assert out.columns == ["doc_id", "lang", *suffixes.RESULTS] and out.count() == 0


def test_query_equals_plain_reference(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = sorted((i, n, gone, len(a), hashlib.sha256(rest).hexdigest()) for i, n, gone, a, _, rest in by_hand(rows, 50))
    assert sorted(tuple(r) for r in queries.QUERIES["op12_suffix_dedup"](spark, sf).collect()) == expected
