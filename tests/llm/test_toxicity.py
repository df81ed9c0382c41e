"""The Kneser-Ney models against plain Python, and scores by tables in several blocks."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickerloom.llm import queries, toxicity

SF = "/root/testdata/sf0.01"
TEXTS = [("You absolute idiot, idiot!", 1), ("an idiot and a clown", 1), ("idiot clown idiot clown", 1), ("", 1),
         ("an ordinary day and a walk", 0), ("Walking all day, and an evening: ordinary", 0), ("a clown walks by day", 0),
         ("ünïcode day", 0), (None, 0)]


def grams_of(text):
    """Plain words of bytes, each with a space after it; histories are filled up with spaces."""
    plain = bytes(toxicity.PLAIN[b] for b in (text or "").encode())
    out = []
    for word in plain.split(b" "):
        filled = b" " * (toxicity.ORDER - 1) + word + b" "
        out += [filled[i:i + toxicity.ORDER] for i in range(len(word) + 1)]
    return out


def plain_model():
    """log ratios by the textbook formulas, as a function of an n-gram."""
    classes = {c: Counter(g for text, label in TEXTS if label == c for g in grams_of(text)) for c in (0, 1)}
    levels = {toxicity.ORDER: classes[0] + classes[1]}
    for size in range(toxicity.ORDER - 1, 0, -1):
        levels[size] = Counter(g[1:] for g in levels[size + 1])
    followers = {size: defaultdict(list) for size in levels}
    for size, counts in levels.items():
        for g, n in counts.items():
            followers[size][g[:-1]].append(n)

    def shared(g):
        if not g:
            return 1 / toxicity.BYTES
        after = followers[len(g)].get(g[:-1])
        if not after:
            return shared(g[1:])
        d = toxicity.DISCOUNT
        return (max(levels[len(g)][g] - d, 0) + d * len(after) * shared(g[1:])) / sum(after)

    def own(c, g):
        after = [n for x, n in classes[c].items() if x[:-1] == g[:-1]]
        if not after:
            return shared(g)
        d = toxicity.CLASS_DISCOUNT
        return (max(classes[c][g] - d, 0) + sum(min(n, d) for n in after) * shared(g)) / sum(after)

    return lambda g: math.log(own(1, g) / own(0, g)), lambda c, h: sum(own(c, h + bytes([b])) for b in range(256))


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(TEXTS)], "doc_id bigint, text string, toxic int").repartition(3)


def test_ratios_equal_plain_python(spark, labelled, monkeypatch):
    counts = toxicity.gram_counts(labelled, "text", "toxic", 2).withColumnsRenamed({"n0": "plain", "n1": "toxic"})
    table, blocks = toxicity.table_of(toxicity.log_ratios(counts))
    ratio, total = plain_model()
    seen = {r["g"].to_bytes(toxicity.ORDER, "big"): r["ratio"] for r in table.collect()}
    assert blocks == 1 and set(seen) == {g for t, _ in TEXTS for g in grams_of(t)}
    assert all(abs(seen[g] - ratio(g)) < 1e-5 for g in seen)
    assert all(abs(total(c, b" an o"[-5:]) - 1) < 1e-9 for c in (0, 1))
    unseen = spark.createDataFrame([(1, "idiots walk"), (2, "xyz"), (3, None), (4, "idiot " * 300)], "id int, text string")
    found = {r["id"]: r for r in toxicity.with_sums(unseen, ["id"], "text", table, 1).collect()}
    for r in unseen.collect():
        grams = grams_of(r["text"])
        assert abs(found[r["id"]]["__ratio"] - sum(map(ratio, grams))) < 1e-3 and found[r["id"]]["__grams"] == len(grams)
    monkeypatch.setattr(toxicity, "TABLE_ROWS", 20)
    small, blocks = toxicity.table_of(toxicity.log_ratios(counts))
    assert blocks > 2
    parts = {r["id"]: r for r in toxicity.with_sums(unseen, ["id"], "text", small, blocks).collect()}
    for i, r in found.items():
        assert parts[i]["__grams"] == r["__grams"] and abs(parts[i]["__ratio"] - r["__ratio"]) < 1e-3 and abs(parts[i]["__clear"] - r["__clear"]) < 1e-3


def test_held_out_toxic_documents_are_found(spark):
    found = queries.QUERIES["op6_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    hits = found.agg(F.sum("predicted").alias("all"), F.sum(F.col("predicted") * F.col("toxic")).alias("right"), F.sum("toxic").alias("toxic")).first()
    assert hits["right"] >= 0.4 * hits["toxic"] and hits["right"] >= 0.8 * hits["all"]


def test_one_id_in_a_third_of_the_rows(spark, labelled):
    """Copies of one labelled row weigh as one row with a count, so what reaches the driver stays bounded."""
    hot = labelled.unionByName(labelled.where("doc_id = 1").crossJoin(spark.range(500)).drop("id"))
    model = toxicity.fit(hot)
    rows = toxicity.score(labelled, model, keep=["doc_id", "score"]).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
