"""URL filters as a temporal list join.

List entries are dated: on a day, a list adds or removes a rule. A rule is a host (it covers its
subdomains) or a host with a path prefix (of whole segments). Entries become validity intervals
from one entry of a list and rule to its next one; an as-of join then evaluates every capture
against the intervals that hold on the day it was fetched. A capture is looked up by each suffix
of its host and each prefix of its path. Before the join, equal lookups of one day are
reduced to one row, which bounds the rows of a host that a third of all captures come from; the answers then go back to
the captures by a join that spreads the lookups of very many captures.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_weighed, table


def host_of(url: Column) -> Column:
    """Host of the URL in lower case, without user, port and a last dot; an address in brackets keeps them; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def lookups(url: Column) -> Column:
    """The rules that would cover the URL: its host's suffixes of two labels or more (the host alone, if it has one label or is an address in brackets), and the host with each prefix of the path."""
    host = host_of(url)
    labels = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    count = F.greatest(F.lit(1), F.size(labels) - 1)
    hosts = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(hosts, F.coalesce(paths, F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """entries (list, rule, day date, active boolean) to intervals (list, rule, since, until): since inclusive, until exclusive or null while it still holds.

    Entries with a null are left out. Of several entries of a list and rule on one day, a removal
    prevails; repeated entries count once.
    """
    whole = entries.dropna(subset=["list", "rule", "day", "active"])
    daily = whole.groupBy("list", "rule", "day").agg(F.min(F.col("active").cast("int")).alias("active"))
    ordered = Window.partitionBy("list", "rule").orderBy("day")
    return daily.withColumn("until", F.lead("day").over(ordered)).where("active = 1").select("list", "rule", F.col("day").alias("since"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame, key: str, url: str = "url", day: str = "day") -> DataFrame:
    """One row per capture row: key, host, day, blocked boolean, n_entries long, lists (sorted, comma-joined), rule (the longest that holds; of equal ones the first).

    URLs that are null or have no host, and null days, are never blocked; lists and rule are then empty. Rows
    that repeat key, URL and day get the same result. An empty list blocks nothing.
    """
    seen = captures.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(day).alias("fetched"))
    looked = seen.select("key", "url", "fetched", F.explode(lookups(F.col("url"))).alias("rule"))
    asked = looked.groupBy("rule", "fetched").agg(F.count("*").alias("asked"))
    holds = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    answers = cut(asked.join(validity(entries), ["rule"]).where(holds).groupBy("rule", "fetched").agg(F.collect_set("list").alias("lists"), F.count("*").alias("n"), F.first("asked").alias("asked")))
    hits = join_weighed(looked.distinct(), answers, ["rule", "fetched"], "asked").groupBy("key", "url", "fetched").agg(
        F.sum("n").alias("n_entries"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lists")))), ",").alias("lists"),
        F.min(F.struct((-F.length("rule")).alias("size"), "rule"))["rule"].alias("rule"),
    ).withColumnsRenamed({"key": "__key", "url": "__url", "fetched": "__day"})
    same = F.col("key").eqNullSafe(F.col("__key")) & (F.col("url") == F.col("__url")) & (F.col("fetched") == F.col("__day"))
    return seen.join(hits, same, "left").select(
        F.col("key").alias(key), host_of(F.col("url")).alias("host"), F.col("fetched").alias(day), F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("rule", F.lit("")).alias("rule"),
    )


def number_of(text: Column, first: int) -> Column:
    """A whole number below 16^4 from the MD5 of the text, at the hexadecimal place `first`."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 4), 16, 10).cast("int")


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with a fetch day derived from page_id (the table has none)."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated entries derived from the hosts and first path segments of all pages: about a third of the rules are added, most of these removed and added again later."""
    looked = pages.select(F.explode(lookups(F.col("url"))).alias("rule")).distinct()
    start, gap = number_of(F.col("rule"), 5) % 300, number_of(F.col("rule"), 9) % 90 + 1
    listed = looked.where(number_of(F.col("rule"), 1) % 3 == 0).select("rule", F.element_at(F.array(F.lit("ads"), F.lit("malware"), F.lit("adult")), number_of(F.col("rule"), 13) % 3 + 1).alias("list"), start.alias("s"), gap.alias("g"))
    changes = F.array(*[F.struct((F.col("s") + k * F.col("g")).alias("offset"), F.lit(k % 2 == 0).alias("active")) for k in range(4)])
    return listed.select("list", "rule", F.explode(changes).alias("c")).select("list", "rule", F.date_add(F.lit("2024-01-01").cast("date"), F.col("c.offset")).alias("day"), "c.active")


ORACLE = r"""
    WITH caps AS (
        SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS day,
               regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1)), '\.$', '') AS host,
               list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
        FROM pages),
    looked AS (
        SELECT page_id, url, day, array_to_string(string_split(host, '.')[i:], '.') AS rule FROM caps, unnest(range(1, CASE WHEN host[1] = '[' THEN 2 ELSE greatest(2, len(string_split(host, '.'))) END)) AS t(i) WHERE host <> ''
        UNION
        SELECT page_id, url, day, host || '/' || array_to_string(segs[1:i], '/') FROM caps, unnest(range(1, len(segs) + 1)) AS t(i) WHERE host <> ''),
    rules AS (
        SELECT rule, ('0x' || md5(rule)[1:4])::INT AS a, ('0x' || md5(rule)[5:8])::INT AS b, ('0x' || md5(rule)[9:12])::INT AS c, ('0x' || md5(rule)[13:16])::INT AS d
        FROM (SELECT DISTINCT rule FROM looked)),
    entries AS (
        SELECT rule, ['ads', 'malware', 'adult'][d % 3 + 1] AS list, DATE '2024-01-01' + CAST(b % 300 + k * (c % 90 + 1) AS INTEGER) AS since, k
        FROM rules, unnest(range(4)) AS t(k) WHERE a % 3 = 0),
    spans AS (SELECT *, lead(since) OVER (PARTITION BY rule, list ORDER BY since) AS until FROM entries),
    hits AS (
        SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, arg_min(l.rule, (-length(l.rule), l.rule)) AS rule
        FROM looked l JOIN spans s ON l.rule = s.rule AND k % 2 = 0 AND since <= day AND (until IS NULL OR day < until) GROUP BY page_id)
    SELECT c.page_id, host, day, n IS NOT NULL AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_entries, coalesce(lists, '') AS lists, coalesce(h.rule, '') AS rule
    FROM caps c LEFT JOIN hits h ON c.page_id = h.page_id"""
