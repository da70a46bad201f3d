"""The queries of problems 2, 3, 6, 8, 9 and 10 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import encoding, mixing, packing, pii, quality, runs
from chatloom.session import read_table


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(read_table(spark, d, "instagram_raw"), read_table(spark, d, "chats"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_repaired(spark, d).select("rec_id", "field")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(read_table(spark, d, "messages"))


def p3_exact(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal contents alone."""
    r = runs.collapse_runs(read_table(spark, d, "messages"), exact=True)
    return r.select("chat_id", "sender", "first_seq", "last_seq", "n_events", "duration_us")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_runs(spark, d).where(F.col("n_events") > 1).select("chat_id", "first_seq", "last_seq")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_items(read_table(spark, d, "messages"), pii.name_model(read_table(spark, d, "contacts")))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(read_table(spark, d, "messages"), pii.name_model(read_table(spark, d, "contacts")))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents"), read_table(spark, d, "containers"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers_used(p8_packed(spark, d))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilisation(p8_packed(spark, d), read_table(spark, d, "containers"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every document for every kind, in whole."""
    return packing.coverage(p8_packed(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, d), read_table(spark, d, "mix_targets"))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    return mixing.limits(p9_mixture(spark, d), read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = quality.text_statistics(read_table(spark, d, "documents"), read_table(spark, d, "common_words"))
    share = lambda c: F.round(c, 6).alias(c)
    return s.select("doc_id", "word_count", share("mean_word_length"), share("symbol_ratio"), share("punctuated_lines"), share("common_words"))


def p10_types(spark: SparkSession, d: str) -> DataFrame:
    typed = quality.classify(read_table(spark, d, "documents"), read_table(spark, d, "common_words"), read_table(spark, d, "doc_labels"))
    return typed.select("doc_id", "word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "kind", "posterior")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_types(spark, d).where(F.col("kind") != "prose").select("doc_id", "kind")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_repaired, p3_found, p3_runs, p3_exact, p6_found, p6_redacted, p8_packed, p8_containers, p8_report, p8_coverage, p9_mixture, p9_shares, p9_limits,
        p10_found, p10_types, p10_statistics,
    )
}
_SOURCE = "lower(regexp_replace({}, '^[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+$', '', 'g'))"
ORACLE_SQL: dict[str, str] = {
    "p3_exact": """SELECT chat_id, ANY_VALUE(sender) AS sender, MIN(seq) AS first_seq, MAX(seq) AS last_seq, COUNT(*) AS n_events, MAX(us) - MIN(us) AS duration_us FROM (
SELECT *, SUM(cut) OVER (PARTITION BY chat_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM (
SELECT *, CASE WHEN sender = LAG(sender) OVER w AND coalesce(content, '') = coalesce(LAG(content) OVER w, '') THEN 0 ELSE 1 END AS cut FROM (
SELECT chat_id, seq, sender, content, epoch_us(timestamp) AS us, ROW_NUMBER() OVER (PARTITION BY chat_id, seq ORDER BY edited NULLS FIRST, batch_no, row_id) AS copy FROM messages WHERE chat_id IS NOT NULL AND seq IS NOT NULL)
WHERE copy = 1 WINDOW w AS (PARTITION BY chat_id ORDER BY seq))) GROUP BY chat_id, k""",
    "p8_coverage": "SELECT container_kind, doc_id, true AS whole FROM (SELECT DISTINCT container_kind FROM containers WHERE capacity_tokens > 0), documents",
    "p9_limits": f"""SELECT source, coalesce(n, 0) AS available, false AS over, 0 AS unknown FROM (SELECT DISTINCT {_SOURCE.format('source')} AS source FROM mix_targets WHERE source IS NOT NULL)
LEFT JOIN (SELECT {_SOURCE.format('source')} AS source, COUNT(*) AS n FROM documents WHERE length(text) > 0 GROUP BY ALL) USING (source)""",
    "p10_statistics": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(trim(lang)) AS lang, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), chr(65039) || chr(8205), ''), '[^\p{L}\p{M}\p{N}''’]+'), lambda w: w <> '') AS words,
list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM documents),
s AS (SELECT *, len(words) AS n, length(translate(array_to_string(words, ''), '''’', '')) AS letters, length(regexp_replace(t, '[\s\x0B\p{Z}]+', '', 'g')) AS solid,
len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[.!?…。»”"'')][ \t]*\r?$'))) AS ended,
CASE WHEN EXISTS (SELECT 1 FROM common_words c WHERE c.lang = d.lang) THEN (SELECT list(lower(word)) FROM common_words c WHERE c.lang = d.lang) ELSE (SELECT list(lower(word)) FROM common_words) END AS known FROM d)
SELECT doc_id, n AS word_count, CASE WHEN n > 0 THEN round(letters / n, 6) END AS mean_word_length, CASE WHEN length(t) > 0 THEN round(greatest(0, solid - letters) / length(t), 6) END AS symbol_ratio,
CASE WHEN len(lines) > 0 THEN round(least(1.0, ended / len(lines)), 6) END AS punctuated_lines, CASE WHEN n > 0 THEN round(least(1.0, len(list_filter(words, lambda w: list_contains(known, w))) / n), 6) END AS common_words FROM s""",
}
