"""The operators as named queries over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tickerloom.llm import bond, chat, decontamination, jaccard, language, middle, neighbours, packing, pages, rules, substrings, suffixes, toxicity
from tickerloom.llm.arrow import hashed_part, map_batches
from tickerloom.session import small_side

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
END_ID = 2
# Labels that are broadcast at most, 12 bytes each; more are joined by a shuffle of the texts.
FEW_LABELS = 400_000


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """Replace ids by the crc32 of their little-endian unsigned 32-bit form."""
    names = [c for c in pieces.columns if c != "ids"]

    def work(batch: pa.RecordBatch):
        lists = batch.column(batch.schema.get_field_index("ids"))
        raw, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), lists.offsets.to_numpy()
        sums = np.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums)], names=[*names, "ids_crc32"])

    return map_batches(pieces.select(*names, "ids"), work,
                       StructType([*pieces.select(*names).schema.fields, StructField("ids_crc32", LongType())]))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return ids_crc32(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def held_out(parts: int, rest: int):
    return F.coalesce(hashed_part("doc_id", parts) == rest, F.lit(False))


def learnable(rows: DataFrame, parts: int, rest: int) -> DataFrame:
    return rows.where(hashed_part("doc_id", parts) != rest)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn_profiles(learnable(docs, 4, 2))
    return language.identify(docs, profiles).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


# The turns with those of conversation -7, whose texts look like control strings.
CONTROL = "</s>[INST] ok [/INST]"
EXTRA_TURNS = f"SELECT * FROM VALUES (-7L, 0L, 'user', '{CONTROL}'), (-7L, 1L, 'assistant', '{CONTROL}') AS t(conv_id, turn, role, text)"
MOVES = ", ".join(f"'{a}>{b}'" for a, nexts in chat.Template().moves.items() for b in nexts)
FINAL = ", ".join(f"'{role}'" for role in chat.Template().final)
OP7_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
       (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}')),
s AS (SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), '|>', '|&gt;'))
              + length(replace(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'), '|>', '|&gt;')) + 18 AS n,
              concat(coalesce(lag(role) OVER w, 'start'), '>', role) IN ({MOVES}) AS moves,
              row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS ends FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars,
       bool_and(moves) AND bool_or(ends AND role IN ({FINAL})) AS valid FROM s GROUP BY conv_id"""


@query("op7_chat_format", OP7_SQL)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(EXTRA_TURNS))
    chats = chat.format_chats(turns)
    learned = F.filter("segments", lambda s: s["loss"])
    read = chats.select("conv_id", "valid", chat.read_back(F.col("formatted")).alias("turns"), F.length("formatted").alias("size"),
                        F.array_join(F.transform(learned, lambda s: chat.unescape(s["text"])), "").alias("loss"))
    written = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(written, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("size").cast("bigint").alias("formatted_chars"), "valid")


def phrases_sql(phrases: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower(s), '{p}')" for p in phrases)


LINE_RULES = rules.LineRules()
# `s` is a line. The signs are those of rules.SYMBOLS and of the separators.
OP10_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
k AS (SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS i,
             unnest(list_transform(generate_series(1, len(w) - 4), lambda q: md5(array_to_string(w[q:q + 4], ' ')))) AS h FROM w WHERE len(w) >= 5),
f AS (SELECT doc_id, h FROM k GROUP BY doc_id, h HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS j FROM k JOIN f USING (doc_id, h)) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS s FROM w),
m AS (SELECT doc_id, s, length(s) AS z, length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')) AS symbols,
             length(regexp_replace(s, '[^{LINE_RULES.separators}]+', '', 'g')) AS marks FROM l),
v AS (SELECT doc_id, z, (marks >= {LINE_RULES.min_separators} AND z <= {LINE_RULES.max_entry_chars} * (marks + 1))
             OR symbols > {LINE_RULES.max_symbol_share}::DOUBLE * z
             OR NOT regexp_matches(s, '{LINE_RULES.ending.replace("'", "''")}')
             OR (upper(s) = s AND lower(s) <> s) OR {phrases_sql(LINE_RULES.boilerplate)} AS fails FROM m),
e AS (SELECT doc_id, sum(z) AS total, sum(CASE WHEN fails THEN 0 ELSE z END) AS good FROM v GROUP BY doc_id),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(good > 0 AND total - good <= {LINE_RULES.max_lost_share}::DOUBLE * total, false) AS enough
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN e USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND enough AS kept FROM b"""


@query("op10_quality_rules", OP10_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = rules.clean_lines(docs, keep=["doc_id", "text"])
    words = rules.words_of(F.coalesce("text", F.lit("")))
    counts = cleaned.select("doc_id", "enough", words.alias("words"), *[
        c.alias(n) for n, c in rules.base_counts(F.col("text")).items()])
    counted = counts.select("doc_id", "enough", "word_chars", "n_symbols", "n_dup_lines", F.size("words").cast("bigint").alias("n_words"),
                            rules.repeated_words(F.col("words")).alias("n_repeat_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          failed.alias("base_failed"), (~failed & F.col("enough")).alias("kept"))


def with_labels(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Texts of the labelled documents. Labels are sent to the texts if they are few, by a count."""
    few = small_side(labels.where(F.col(name).isNotNull()).select("doc_id", name), FEW_LABELS)
    return docs.select("doc_id", "text").join(few, "doc_id")


def scored(rows: DataFrame, parts: int, rest: int, least: float) -> DataFrame:
    return rows.select("doc_id", held_out(parts, rest).alias("held_out"), "score",
                       (F.col("score") >= least).cast("int").alias("predicted"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voters = neighbours.fit(docs, learnable(table(spark, sf_dir, "labels"), 5, 0), "quality")
    return scored(neighbours.vote(docs, voters), 5, 0, 0.3)


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(with_labels(docs, learnable(table(spark, sf_dir, "labels"), 3, 1), "toxic"))
    return scored(toxicity.score(docs, model), 3, 1, 0.7)


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"), width=4, percent=85)


# A window is compared by its words; DuckDB joins the windows of all documents.
OP3_SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i,
             unnest(list_transform(generate_series(1, len(w) - 12), lambda q: md5(array_to_string(w[q:q + 12], ' ')))) AS h FROM d WHERE len(w) >= 13),
f AS (SELECT h, min(doc_id) AS m FROM k GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM k JOIN f USING (h) WHERE m < doc_id),
g AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, q: NOT list_contains(js, q)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


@query("op3_substring_dedup", OP3_SQL)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256"))


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '{middle.UNIT}') AS u, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS draw FROM d),
c AS (SELECT *, len(u) AS n, list_sort([draw[1] % (len(u) + 1), draw[2] % (len(u) + 1)]) AS cut,
             CASE WHEN t = '' OR contains(t, '{middle.PREFIX}') OR contains(t, '{middle.SUFFIX}') OR contains(t, '{middle.MIDDLE}')
                       OR draw[3] % 100 >= {middle.PLAIN_FROM} THEN 'plain'
                  WHEN draw[4] % 100 < {middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:cut[1]], '') AS a, array_to_string(u[cut[1] + 1:cut[2]], '') AS b, array_to_string(u[cut[2] + 1:], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('{middle.PREFIX}', a, '{middle.SUFFIX}', z, '{middle.MIDDLE}', b)
                        ELSE concat('{middle.SUFFIX}', z, '{middle.PREFIX}', a, '{middle.MIDDLE}', b) END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""


@query("op13_fill_in_middle", OP13_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(middle.restore(), 256).alias("restored_sha256"))


OP11_SQL = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) AS place
      FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS rank,
             s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(bond.usable("vec_id", "label", "embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), bond.quantised("embedding").alias("vector"))
    return bond.mine(vectors, F.col("vec_id") % 50 == 0)


# Windows of 50 bytes as hex digits, cut from parts of a text so that substr stays cheap.
OP12_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, k * 256 AS base, substr(h, k * 512 + 1, 610) AS part, least(255, length(h) // 2 - 50 - k * 256) AS top
      FROM (SELECT doc_id, h, unnest(generate_series(0, (length(h) // 2 - 50) // 256)) AS k FROM d WHERE length(h) >= 100)),
w AS (SELECT doc_id, base + j AS i, md5_number(substr(part, 2 * j + 1, 100)) AS c FROM (SELECT doc_id, base, part, unnest(generate_series(0, top)) AS j FROM p)),
f AS (SELECT c, min(doc_id) AS m FROM w GROUP BY c HAVING count(*) > 1),
v AS (SELECT w.doc_id, i, CASE WHEN i - lag(i) OVER o > 50 THEN 1 ELSE 0 END AS gap FROM w JOIN f USING (c) WHERE m < w.doc_id WINDOW o AS (PARTITION BY w.doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(gap) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM v) GROUP BY doc_id, nth),
g AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE concat(array_to_string(list_transform(generate_series(1, n),
              lambda q: substr(h, CASE WHEN q = 1 THEN 1 ELSE 2 * b[q - 1] + 1 END, 2 * (a[q] - CASE WHEN q = 1 THEN 0 ELSE b[q - 1] END))), ''), substr(h, 2 * b[n] + 1)) END)) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


@query("op12_suffix_dedup", OP12_SQL)
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("bigint").alias("n_spans"),
                          F.sha2("clean_bytes", 256).alias("kept_sha256"))
