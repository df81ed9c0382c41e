"""The pipeline's stages, each against plain Python on its own input, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import compare, connect
from tests.llm.test_pairs import brute_components, brute_removal
from tickerloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = out.collect()
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r["doc_id"] for r in after}
        if name == "language_id":
            assert ids == {r["doc_id"] for r in before if any(map(str.isalpha, r["text"] or ""))}
        elif name == "jaccard_join":
            assert ids == {i for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80) if i == c}
        elif name == "substring_dedup":
            wanted = {i: t for i, t, _, _ in brute_removal([(r["doc_id"], r["text"]) for r in before], 13)}
            assert {r["doc_id"]: r["text"] for r in after} == wanted and all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "decontamination":
            items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = {r["doc_id"] for r in before if any(t in " ".join(r["text"].lower().split()) for t in items)}
            assert not ids & held and len(ids) >= len(before) - len(held) - 2
        else:
            assert ids == {r["doc_id"] for r in before}
            assert sum(r["length"] for r in after) == sum({r["doc_id"]: r["doc_tokens"] for r in after}.values())
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_on_hard_rows(spark, hard_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (hard_docs.select(columns), no_docs.select(columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= (docs.count() > 0)
            docs = out if name != "packing" else docs


def test_one_row_of_each_group_of_near_copies_stays(spark, prose_of):
    one, two, three, four = (prose_of(k, 60) for k in (801, 802, 803, 804))
    rows = [(1, one), (1, one), (1, one), (5, one + " more"), (5, two), (7, one), (None, one), (None, three), (None, three),
            (None, three + " more"), (None, four), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "xx", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.near_copies(spark, docs.repartition(3), SF)
    found = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert left.columns == docs.columns
    near = [(i, t.removesuffix(" more") if t else t) for i, t in found]
    assert sorted(near, key=repr) == sorted([(1, one), (5, two), (None, three), (None, four), (9, None), (None, "")], key=repr)


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_equals_sql(spark, name):
    ok, message, _ = compare(spark, connect(SF), name, queries.QUERIES[name], queries.CHECKS[name], SF)
    assert ok, message


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_further_columns(spark, hard_docs, stage):
    names = ["score", "n_words", "lang_pred", "is_text", "clean_text", "n_removed", "rid", "bucket"]
    docs = hard_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n} of "), F.coalesce("text", F.lit(""))).alias(n) for n in names])
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, "/root/testdata/sf0.001")
    assert found.columns == docs.columns
    given = {tuple(r[n] for n in names) for r in docs.collect()}
    rows = found.collect()
    assert rows and {tuple(r[n] for n in names) for r in rows} <= given
