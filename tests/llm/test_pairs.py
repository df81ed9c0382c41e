"""Near copies, repeated passages and benchmark items against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tickerloom.llm import decontamination, graph, jaccard, substrings

SPLIT = re.compile("[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = SPLIT.findall((t or "").translate(LOW))
        sets.append((i, {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i, len(s), None if i is None else least[root(a)]) for a, (i, s) in enumerate(sets)), key=repr)


def edited(words, rng, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_near_copies_equal_brute_force(spark, prose_of, width, percent):
    rng, rows = random.Random(5), []
    for family in range(12):
        words = prose_of(family + 50, rng.randrange(6, 150)).split()
        rows += [(len(rows) * 3 + k, edited(words, rng, k % 7)) for k in range(rng.randrange(1, 12))]
    rows += [(2000 + k, prose_of(77, 30) + " " + prose_of(300 + k, 30 + k)) for k in range(20)]  # a shared passage
    rows += [(3000, "Mixed CASE words here now"), (3001, "mixed case words here now"), (3002, "two words"), (3003, "two words")]
    found = jaccard.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), width, percent)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows, width, percent)


def test_near_copies_of_hard_rows(hard_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    found = jaccard.near_copies(hard_docs, 4, 85)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows, 4, 85)
    assert jaccard.near_copies(no_docs).count() == 0


def test_salted_tokens_and_large_groups_lose_no_link(spark, prose_of, monkeypatch):
    monkeypatch.setattr(jaccard, "TOKEN_ROWS", 2)
    monkeypatch.setattr(jaccard, "PARTNERS", 2)
    rng = random.Random(3)
    words = prose_of(8, 80).split()
    rows = [(k, edited(words, rng, k % 4)) for k in range(40)]
    found = jaccard.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows, 4, 85)


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (200, 200)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_removal(rows, width):
    first, out = {}, []
    for i, t in rows:
        w = SPLIT.findall(t or "")
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k:k + width])
                first[key] = min(i, first.get(key, i))
    for i, t in rows:
        w = SPLIT.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        out.append((i, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [3, 13])
def test_repeats_equal_brute_force(spark, prose_of, width, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 2000)
    monkeypatch.setattr(substrings, "GROUP_ENTRIES", 50)
    monkeypatch.setattr(substrings, "FLUSH", 200)
    rng = random.Random(1)
    passages = [prose_of(900 + k, rng.randrange(5, 60)) for k in range(8)]
    rows = [(rng.randrange(10**6), " ".join([prose_of(k, rng.randrange(0, 40)), rng.choice(passages), prose_of(k + 400, 9), rng.choice(passages)]))
            for k in range(80)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), width)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_removal(rows, width)


def test_repeats_of_hard_rows(hard_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    found = substrings.remove_repeats(hard_docs, keep=("lang", "key", "clean_text"))
    assert found.columns == ["doc_id", "lang", "key", "clean_text", "n_words", "n_removed"]
    got = sorted(((r["doc_id"], r["clean_text"], r["n_words"], r["n_removed"]) for r in found.collect()), key=repr)
    assert got == brute_removal(rows, 13)
    assert substrings.remove_repeats(no_docs).count() == 0


def test_rows_of_one_id_are_dealt_to_several_groups(spark, prose_of, monkeypatch):
    """A third of the rows with one id, and equal texts without an id, give what each row gives by itself."""
    monkeypatch.setattr(substrings, "GROUP_BYTES", 2000)
    monkeypatch.setattr(substrings, "GROUP_ENTRIES", 50)
    shared = prose_of(500, 40)
    hot = [(7, f"{prose_of(i, 15)} {shared if i % 3 else ''} {prose_of(100 + i, 10)}") for i in range(60)]
    rows = hot + [(None, prose_of(600, 60))] * 40 + [(i, prose_of(200 + i, 20) + (" " + shared if i % 4 == 1 else "")) for i in range(8, 60)] + [(2, shared)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    want = Counter((i, len(t.split()), 40 if i is not None and i > 2 and shared in t else 0) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in found) == want


def test_texts_with_too_many_words_for_letters(spark, prose_of, monkeypatch):
    monkeypatch.setattr(substrings, "LETTERS", 10)
    rows = [(k, prose_of(5, 60) + " " + prose_of(k + 20, 20)) for k in range(4)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    # Tasks import the module anew, so the limit is also tried in this process.
    assert sorted(map(tuple, found.collect()), key=repr) == brute_removal(rows, 13)
    import numpy as np
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    w = substrings.Windows(data, np.array([0, len(data)]), 13)
    covered = np.zeros(len(w.words) + 1, np.int64)
    substrings.locate(w, np.array([5]), np.array([True]), w.hashes()[:3], np.array([1, 1, 9]), covered)
    assert (np.cumsum(covered)[:-1] > 0).tolist() == [k < 14 for k in range(80)]


def test_items_are_found_when_paraphrased(spark, prose_of):
    rng = random.Random(2)
    items = [(k, prose_of(5000 + k, rng.randrange(20, 60)) + ".") for k in range(30)]
    docs, planted = [], set()
    for k in range(400):
        words = prose_of(k, 150).split()
        if k % 4 == 0:
            item, text = items[k // 4 % 30]
            parts = [w for w in text.rstrip(".").split() if rng.random() > 0.1]
            words[40:40] = parts
            planted.add((k, item))
        docs.append((k, " ".join(words)))
    docs += [(1000, None), (None, ""), (None, items[3][1]), (1001, items[4][1])]
    bench = spark.createDataFrame([*items, (None, None), (98, "")], "item_id bigint, text string")
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)
    pairs = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert len(pairs & planted) >= 0.9 * len(planted)
    assert pairs - planted <= {(None, 3), (1001, 4)} and (1001, 4) in pairs and (None, 3) in pairs


def test_decontamination_of_hard_rows(spark, hard_docs, no_docs, prose_of):
    bench = spark.createDataFrame([(1, prose_of(1, 120)), (1, prose_of(1, 120)), (2, "not there at all, never ever seen")], "item_id bigint, text string")
    rows = decontamination.contaminated(hard_docs, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in rows) == sorted([(d, 1) for d in (1, 2, 2, 3, -1)] * 2)
    kept = decontamination.without_items(hard_docs, bench)
    assert kept.columns == hard_docs.columns and kept.count() == hard_docs.count() - 5
    assert decontamination.contaminated(no_docs, bench).count() == 0
    assert decontamination.contaminated(hard_docs, bench.where("false")).count() == 0
    assert decontamination.without_items(hard_docs, bench.where("false")).count() == hard_docs.count()


def test_short_and_common_items_are_found_word_for_word(spark, prose_of):
    short, common, copied = "zebra quagga okapi tapir", "as it is so it was and so it is", prose_of(7000, 20)
    docs = []
    for k in range(60):
        words = prose_of(k, 60).split()
        words[::4] = ["as", "it", "is", "so", "was", "and"][k % 6:] + words[::4][6 - k % 6:]
        if k % 10 == 1:
            words[30:30] = short.split()
        if k % 10 == 2:
            words[30:30] = common.split()
        if k % 3 == 0:
            words = words[:12] + copied.split()
        docs.append((k, " ".join(words)))
    docs += [(100, "zebra quagga okapi and tapir"), (101, "Zebra, quagga: OKAPI tapir!")]
    edited_copy = copied.split()
    edited_copy[9:10] = []
    docs.append((102, " ".join(prose_of(9000, 30).split() + edited_copy)))
    bench = spark.createDataFrame([(1, short), (2, common), (3, copied), (4, "..."), (5, "zebra tapir")], "item_id bigint, text string")
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    wanted = {(k, 1) for k in range(60) if k % 10 == 1 and k % 3} | {(k, 2) for k in range(60) if k % 10 == 2 and k % 3}
    wanted |= {(k, 3) for k in range(0, 60, 3)} | {(101, 1), (102, 3)}
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted and len(found) == len(wanted)


def test_copies_are_found_without_a_latent_candidate(prose_of):
    import numpy as np
    import pyarrow as pa

    terms = 1 << decontamination.TERM_BITS
    idf, rare, blind = np.full(terms, 9.0), np.ones(terms, bool), np.zeros((terms, 4), np.float32)
    items = decontamination.Items.of([1, 2], [prose_of(60, 30), prose_of(61, 30)], blind, idf, rare)
    texts = pa.array([prose_of(1, 50) + " " + prose_of(61, 30) + " " + prose_of(2, 50), prose_of(3, 99)])
    found = [decontamination.hits(p, items, blind) for _, p in decontamination.passages_of(texts, rare)]
    assert found == [[(0, 1, 1.0, 1.0, 1.0)]] and (decontamination.RANK, decontamination.SPARE) == (128, 12)


def test_longest_common_subsequence():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert decontamination.common_order(masks, len(a), b) == plain(a, b)


def test_latent_space_counts_the_passages_of_all_documents(spark):
    texts = [f"alpha{i} beta{i}" for i in range(6000)]
    rare = np.ones(1 << decontamination.TERM_BITS, bool)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    table = decontamination.latent_space(docs, rare + 1.0, rare, "text")
    seen = np.zeros(len(rare), bool)
    for _, p in decontamination.passages_of(pa.array(texts)):
        seen[decontamination.terms_of(p.words)] = True
    assert (np.abs(table).sum(axis=1) > 1e-9).tolist() == seen.tolist()


def test_co_occurrences_equal_plain_counts(spark, prose_of):
    texts = [None, "", "one", "two two two", "same " * 3000, *[prose_of(i, 5 + 7 * i) for i in range(12)]]
    terms, rows = 1 << decontamination.TERM_BITS, decontamination.ROWS
    rare = np.ones(terms, bool)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found, want = np.zeros((terms, terms), np.int64), np.zeros((terms, terms), np.int64)
    for r in decontamination.co_occurrences(docs, rare, "text").collect():
        first = r["part"] * rows
        inside = np.arange(terms) <= first + np.arange(rows)[:, None]
        found[first:first + rows][inside] = decontamination.counts_of(r["part"], r["width"], r["counts"])
    for _, p in decontamination.passages_of(pa.array(texts, pa.string()), rare):
        start, stop, _, _ = p.spans()
        for a, b in zip(start, stop, strict=True):
            kinds, times = np.unique(decontamination.terms_of(p.words)[a:b], return_counts=True)
            want[np.ix_(kinds, kinds)] += np.outer(times, times)
    assert (found == np.tril(want)).all() and want.max() > 255
