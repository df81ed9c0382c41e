"""Operators that work row by row: exact round trips, plain Python, held-out accuracy, and hard rows."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import chat, language, neighbours, packing, pages, queries, rules, toxicity

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_pieces_hold_every_token_once(spark, hard_docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    docs = hard_docs
    pieces = packing.pack(docs.where("doc_id is not null"), path, 2, max_tokens=512, keep=["doc_id", "source", "length", "ids"])
    assert pieces.columns == ["doc_id", "source", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    rows = pieces.collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").collect()}
    copies = collections.Counter(r["doc_id"] for r in docs.where("doc_id is not null").collect())
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    for i, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        own = sorted((r["start"], r["sequence_id"], r["length"], r["ids"]) for r in rows if r["doc_id"] == i)
        assert all(size == len(x) and size & (size - 1) == 0 and size <= 512 for _, _, size, x in own)
        seen = collections.Counter((s, tuple(x)) for s, _, _, x in own)
        assert set(seen.values()) == {copies[i]}
        assert [t for s, x in sorted(seen) for t in x] == ids and all(r["doc_tokens"] == len(ids) for r in rows if r["doc_id"] == i)


def test_packing_of_no_rows_and_bad_sizes(no_docs):
    assert packing.pack(no_docs, queries.tokenizer_path(), 2).count() == 0
    with pytest.raises(ValueError):
        packing.pack(no_docs, queries.tokenizer_path(), 2, max_tokens=1000)


def test_words_with_special_tokens_keep_their_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tickerloom.llm.arrow import text_bytes

    texts = ["a<|endoftext|>b", "X<|ENDOFTEXT|>Y it's 'sx''s", "", "Σας ΑΣ é x́ 12ab3", "a\x1cb\x85c d don't!!,,''x"]
    encode, tokenizer = packing.WordEncoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    for group in (texts, texts[1:4]):
        ids, bounds = encode(*text_bytes(pa.array(group)))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [
            tokenizer.encode(t, add_special_tokens=False).ids for t in group]


def test_crc_query_reads_pieces(spark):
    row = queries.QUERIES["op4_packing"](spark, SMALL).where("doc_id = 3").orderBy("start").first()
    text = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id = 3").first()["text"]
    from tokenizers import Tokenizer
    ids = [*Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids, 2]
    assert row["ids_crc32"] == zlib.crc32(np.array(ids[:row["length"]], "<u4").tobytes())


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="top">Site name</header><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav>
<div id="cookie-notice">We use cookies.</div><!-- c --><article><header><h1>A &amp; B</h1></header>
<p>First <b>par</b>agraph, long enough to look like content of a page.<br>After a break.<p>Short.
<div class="ad">Buy</div><form>Name <input><button>Go</button></form></article>
<aside>Side</aside><section class="comments"><p>Nice post!</p></section><footer>&copy; x</footer></body></html>"""


def test_page_keeps_the_article_only():
    assert pages.main_text(PAGE) == "A & B First paragraph, long enough to look like content of a page. After a break. Short."


def test_page_without_content_elements():
    text = "Long text that goes on and on for quite a while so that it clearly is the content. "
    html = f"<div><h2>Head</h2><p>{text * 2}</p><p>{text}</p></div><ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li></ul>"
    assert pages.main_text(html) == ("Head " + text * 2 + text).strip()


def test_unclosed_furniture_does_not_swallow_the_article():
    assert pages.main_text("<nav><ul><li>x<article><p>Body of the text.</article>") == "Body of the text."


def test_hard_pages(spark):
    html = [(1, "u", ""), (2, None, None), (None, "u", "plain"), (3, "u", "<p>" + "word " * 300_000), (3, "u", "<"), (4, "u", "<!-- <p>x"), (5, "u", "&lt;b&gt;&#8364;\xa0x")]
    df = spark.createDataFrame(html, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    rows = pages.extract(df, keep=["page_id", "url", "text"]).collect()
    assert [r["text"] for r in rows][:3] == ["", "", "plain"] and rows[3]["n_chars"] == 5 * 300_000 - 1
    assert rows[6]["text"] == "<b>€ x" and all(len(r["text"]) == r["n_chars"] for r in rows) and len(rows) == 7
    assert pages.extract(df.where("false")).count() == 0


def test_pages_query_finds_every_article(spark):
    import html as escapes

    found = {r["page_id"]: r["text"] for r in queries.QUERIES["op5_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        plain = escapes.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body)))
        assert found[r["page_id"]] == " ".join(plain.split())


def test_chat_round_trip(spark):
    odd = "&lt;|end|>\n<|turn:user|>\n</s> &amp;amp; <<||>> \\ |> <|"
    rows = [(1, 0, "system", odd), (1, 1, "user", ""), (1, 2, "assistant", odd), (2, 1, "assistant", "b"), (2, 0, "user", None),
            (None, None, None, None), (3, 0, "odd|>role<|", "x\n"), (3, 0, "odd|>role<|", "x\n"), (4, 0, "user", "q" * 500_000), (4, 1, "assistant", "\n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit(0))
    chats = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert len(chats) == 5
    for c in chats:
        own = sorted((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c["conv_id"])
        assert [(b["role"], b["text"]) for b in c["back"]] == [(r, x) for _, r, x in own] and c["n_turns"] == len(own)
        assert "".join(s["text"] for s in c["segments"]) == c["formatted"]
        assert [s["text"] for s in c["segments"] if s["loss"]] == [
            x.replace("&", "&amp;").replace("<|", "&lt;|").replace("|>", "|&gt;") for _, r, x in own if r == "assistant"]
    assert {c["conv_id"]: c["valid"] for c in chats} == {1: True, 2: True, 3: False, 4: True, None: False}
    assert chat.format_chats(df.where("false")).count() == 0


def test_turn_order_follows_the_template(spark):
    orders = {"ua": True, "sua": True, "uaua": True, "u": False, "a": False, "uu": False, "us": False, "": None, "sa": False, "uas": False}
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(k, i, names[c], "t") for k, turns in enumerate(orders) for i, c in enumerate(turns)]
    found = {r["conv_id"]: r["valid"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert found == {k: v for k, v in enumerate(orders.values()) if v is not None}


def test_own_template(spark):
    mine = chat.Template(open="<|", after_role="|> ", close="<|/|>", loss_roles=("bot",), moves={"start": ("human",), "human": ("bot",)}, final=("bot",))
    df = spark.createDataFrame([(1, 0, "human", "hi"), (1, 1, "bot", "yo")], "conv_id int, turn int, role string, text string")
    row = chat.format_chats(df, mine).first()
    assert row["formatted"] == "<|human|> hi<|/|><|bot|> yo<|/|>" and row["valid"]


def counts_of(text):
    w = re.findall("[^\x20\x09-\x0D]+", text)
    seen, covered = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)), set()
    for k in range(len(w) - 4):
        if seen[tuple(w[k:k + 5])] > 1:
            covered.update(range(k, k + 5))
    lines = [s for s in text.split("\n") if re.search("[^\x20\x09-\x0D]", s)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_base_counts_equal_plain_python(spark, hard_docs):
    odd = spark.createDataFrame([(20, "a b c d e a b c d e"), (21, "x x x x x x"), (22, "a b c d e f a b c d e"), (23, "l\n\nl\r\nl\n \nm"), (24, "\x1c# *\x85|")],
                                "doc_id bigint, text string")
    both = hard_docs.select("doc_id", "text").unionByName(odd)
    words = rules.words_of(F.coalesce("text", F.lit("")))
    rows = both.select("text", words.alias("w")).select("text", F.size("w").alias("n"), *rules.base_counts(F.col("text")).values(),
                                                        rules.repeated_words(F.col("w")).alias("r")).collect()
    for r in rows:
        assert tuple(r)[1:] == counts_of(r["text"] or ""), r


def test_line_rules(spark, hard_docs, no_docs):
    good = "This is a line of prose that ends well.\n"
    cases = {good * 3: True, "Home | News | About | Contact\n" + good: True, "Home | News | About | Contact\n" * 5 + good: False,
             "no end here": False, "LOUD WORDS ONLY!\n" * 2: False, "All rights reserved.": False, "": False, "#### $$$$ ****.": False}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    assert [r["enough"] for r in rules.clean_lines(df).orderBy("doc_id").collect()] == list(cases.values())
    found = rules.clean_lines(hard_docs, keep=["doc_id", "clean_text", "lang"])
    assert found.columns == ["doc_id", "lang", "clean_text", "lost_chars", "n_line_chars", "enough"] and found.count() == hard_docs.count()
    assert not found.where("enough is null or clean_text is null").count() and rules.clean_lines(no_docs).count() == 0


def test_languages_of_held_out_documents(spark):
    found = queries.QUERIES["op9_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.98 and 0 <= row[1] and row[2] <= 1


def test_languages_of_hard_rows(hard_docs, no_docs):
    profiles = language.learn_profiles(hard_docs)
    assert sorted(profiles) == ["xx", "yy"]
    found = language.identify(hard_docs, profiles, keep=["doc_id", "text", "score"])
    for r in found.collect():
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) and r["is_text"] == (r["lang_pred"] != "und")
    assert language.learn_profiles(no_docs) == {} and language.identify(no_docs, profiles).count() == 0
    assert {r["lang_pred"] for r in language.identify(hard_docs, {}).collect()} == {"und"}


def test_gram_counts_of_blocks_add_up(monkeypatch, prose_of):
    data = np.frombuffer(prose_of(1, 500).encode(), np.uint8)
    whole = dict(zip(*map(list, language.gram_counts(data))))
    monkeypatch.setattr(language, "BLOCK_BYTES", 1000)
    parts = dict(zip(*map(list, language.gram_counts(data))))
    assert sum(parts.values()) == pytest.approx(sum(whole.values()), rel=0.02) and set(whole) - set(parts) <= set(whole)


def area(scores, labels):
    order = np.argsort(np.argsort(scores))
    ones = labels == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("name,label,least", [("op8_quality_classifier", "quality", 0.95), ("op6_toxicity", "toxic", 0.75)])
def test_scores_of_held_out_documents(spark, name, label, least):
    found = queries.QUERIES[name](spark, SF)
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", label).toPandas()
    assert area(rows["score"].to_numpy(), rows[label].to_numpy()) > least
    assert found.count() == 1000 and found.where("score < 0 or score > 1 or score is null or isnan(score)").count() == 0


def test_classifiers_of_hard_rows(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, 1), (10, 0), (None, 1), (7, None), (8, 5)], "doc_id bigint, y int")
    voters = neighbours.fit(hard_docs, labels, "y")
    assert neighbours.fit(hard_docs, labels.where("false"), "y") is None
    known = hard_docs.join(labels, "doc_id")
    model = toxicity.fit(known, "y")
    none = toxicity.fit(known.where("false"), "y")
    for found in (neighbours.vote(hard_docs, voters, keep=["doc_id", "score"]), neighbours.vote(hard_docs, None),
                  toxicity.score(hard_docs, model, keep=["doc_id", "score"]), toxicity.score(hard_docs, none)):
        rows = found.collect()
        assert len(rows) == hard_docs.count() and found.columns == ["doc_id", "score"]
        assert all(0 <= r["score"] <= 1 for r in rows)
    assert neighbours.vote(no_docs, voters).count() == 0 and toxicity.score(no_docs, model).count() == 0


def test_encoded_runs_stay_flat():
    encoder = packing.WordEncoder(queries.tokenizer_path())
    for runs in (["cat"], ["cat", "unbelievably", "straße"], ["...", "cat", "x1"]):
        ids, sizes = encoder.encode_runs(runs)
        want = [encoder.tokenizer.encode(r, add_special_tokens=False).ids for r in runs]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
