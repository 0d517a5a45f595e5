"""The subpackage's queries over the given tables, and SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .decontamination import contamination_report
from .fill_in_middle import middle_report
from .filter_audit import filter_audit
from .jaccard_join import near_duplicates
from .language_id import language_report
from .license_rules import CONFIDENCE, every_rule, needed, spelled
from .license_scan import license_report
from .media import media_report
from .mixing import mix
from .quality import quality_report
from .recurrent_lm import lm_report
from .sharding import shard_documents
from .token_counts import fill_cache, token_report
from .url_filters import ORACLE, filter_captures, page_captures, page_entries


def op1_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved")


def op2_jaccard_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op3_mix_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "rate", "copies")


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_report(table(spark, sf_dir, "documents"))


def op5_language_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op6_url_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = page_captures(spark, sf_dir)
    return filter_captures(captures, page_entries(captures), "page_id")


def op7_quality_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two loads, so the second finds the counts of the first (and of copies) in the cache."""
    documents, cache = table(spark, sf_dir, "documents"), scratch(spark, "token-cache")
    fill_cache(documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), cache)
    return token_report(documents, cache)


def op9_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(table(spark, sf_dir, "documents"))


def op10_decontaminate_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_shard_ring, op2_jaccard_chosen_path, op3_mix_entropy_balancing, op4_recurrent_lm, op5_language_rank_order,
        op6_url_temporal_list, op7_quality_additive_model, op8_token_digest_cache, op9_media_png, op10_decontaminate_prefix_join,
        op11_license_rules, op12_filter_audit, op13_fill_in_middle,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: The rules as rows of SQL, each with a word that all texts have which it matches.
_RULES = ", ".join(
    f"({k}, {r.tier}, '{r.label}', {CONFIDENCE[r.tier]}, {str(r.base).lower()}, '{spelled(r.pattern)}', '{next((f' {n[0]} ' for n in needed(r.pattern) if len(n) == 1), '')}')" for k, r in enumerate(every_rule()))

ORACLE_SQL: dict[str, str] = {
    "op11_license_rules": f"""
        WITH rules(rule, tier, label, confidence, base, regex, word) AS (VALUES {_RULES}),
        docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        texts AS MATERIALIZED (SELECT r, ' ' || array_to_string(w, '  ') || ' ' AS t FROM docs WHERE len(w) > 0),
        hits AS MATERIALIZED (SELECT r, t, rules.* FROM texts JOIN rules ON contains(t, word) WHERE regexp_matches(t, regex)),
        cut AS (SELECT r, rule, tier, label, confidence, base, list_transform(regexp_extract_all(t, regex), lambda x: CAST((len(x) - len(replace(x, ' ', ''))) / 2 AS INTEGER)) AS inside,
                       list_transform(regexp_split_to_array(t, regex), lambda x: CAST((len(x) - len(replace(x, ' ', ''))) / 2 AS INTEGER)) AS outside FROM hits),
        places AS MATERIALIZED (
            SELECT r, rule, tier, label, confidence, base, list_sum(outside[1:k]) + coalesce(list_sum(inside[1:k - 1]), 0) AS a, list_sum(outside[1:k]) + list_sum(inside[1:k]) AS b
            FROM (SELECT *, unnest(range(1, len(inside) + 1)) AS k FROM cut)),
        kept AS (
            SELECT p.* FROM places p WHERE NOT EXISTS (
                SELECT 1 FROM places q WHERE q.r = p.r AND q.a <= p.a AND q.b >= p.b AND q.tier <= p.tier AND (q.a, q.b, q.tier, q.rule) <> (p.a, p.b, p.tier, p.rule)
                AND NOT (q.a = p.a AND q.b = p.b AND q.tier = p.tier AND q.rule > p.rule))),
        bases AS (SELECT r, count(*) AS n, min(a) AS first, max(a) AS last, list_sort(list(DISTINCT label)) AS labels FROM places WHERE base GROUP BY r),
        found AS (SELECT r, count(*) AS n, max(confidence) AS score, list(DISTINCT label) AS labels FROM kept GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(bases.n, 0) AS BIGINT) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
               coalesce(array_to_string(bases.labels, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
               CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(found.n, 0) AS BIGINT) AS n_detections
        FROM docs LEFT JOIN bases USING (r) LEFT JOIN found USING (r)""",
    "op6_url_temporal_list": ORACLE,
    "op10_decontaminate_prefix_join": f"""
        WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        wins AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
            FROM items, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
        docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM wins),
        grams AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
        hits AS (SELECT DISTINCT doc_id, g.n, i, item FROM grams g JOIN wins s ON g.win = s.win AND g.n = s.n),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
        found AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id""",
    "op12_filter_audit": r"""
        WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        split AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
        fails AS (
            SELECT doc_id, part,
                   CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS cell
            FROM split),
        judged AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        cells AS (SELECT part, cell, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fails LEFT JOIN judged USING (doc_id) GROUP BY part, cell),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
            JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
        steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS gone FROM orders, range(1, 6) AS r(step)),
        judged_cells AS (
            SELECT part, filter_order, step, f, n, good, toxic, cell, contains(cell, f) AS failing, gone <> '' AND regexp_matches(cell, '[' || CASE WHEN gone = '' THEN '_' ELSE gone END || ']') AS before
            FROM cells, steps),
        counted AS (
            SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT before AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT before), 0) AS removed,
                   coalesce(sum(n) FILTER (failing AND before), 0) AS redundant, coalesce(sum(n) FILTER (cell = f), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (failing AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT before), 0) AS toxic_lost
            FROM judged_cells GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM counted""",
    "op13_fill_in_middle": r"""
        WITH units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        drawn AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM units),
        cut AS (
            SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
                   array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
                   array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix
            FROM drawn)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM cut""",
}
