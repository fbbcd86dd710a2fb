"""URL rules by host suffix and path prefix: an equi-join on short hash prefixes, then full digests and precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
HASH_PREFIX = 8  # hex digits, 32 bits


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url; other columns are ignored).

    ``rules`` has verdict (allow or block), rule_host (lower case) and rule_path. The host lies
    after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
    from there up to ``?``, ``#`` or the end; without ``://``, or with a null
    url, both are empty. A rule fits its host and all subdomains, if the path
    starts with the rule's path. The longest (host plus path) wins, of these the longer
    host, of equal ones block. A url no rule fits, so an empty or null one too,
    has a null rule and the verdict ``default``. Every row comes back once,
    repeated ones as often as they occur; empty tables give no rows.

    Each distinct (host, path) is expanded into its host suffixes times its path
    prefixes, at the lengths that occur among the rules, hashed, and joined on
    the first 32 bits of the digest; the full digest confirms. Pages then take
    their (host, path)'s rule by one more equi-join.
    """
    hexes = F.md5(F.concat_ws("\n", "rule_host", "rule_path").cast("binary"))
    hashed = (rules.where("rule_host is not null and rule_path is not null")
              .select("verdict", "rule_host", "rule_path", hexes.alias("digest"))
              .withColumn("short", F.substring("digest", 1, HASH_PREFIX)))
    # distinct lengths only: no more of them than the longest rule path has characters
    lengths = sorted(r[0] for r in hashed.select(F.char_length("rule_path")).distinct().collect())

    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    split = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                               "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))

    labels = F.split("host", r"\.")
    places = split.where("host <> ''").select("host", "path").distinct()
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("path"))
    expressions = (places.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
        .alias("suffix"))
        .select("host", "path", "suffix", F.explode(fitting).alias("n"))
        .select("host", "path", F.md5(F.concat_ws("\n", "suffix", F.expr("left(path, n)")).cast("binary"))
                .alias("full"))
        .withColumn("short", F.substring("full", 1, HASH_PREFIX)))
    best = F.max(F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("n"),
                          F.char_length("rule_host").alias("h"), F.col("verdict").alias("verdict"),
                          F.concat("rule_host", "rule_path").alias("rule")))  # block > allow
    found = (expressions.join(hashed, "short").where("full = digest").groupBy("host", "path").agg(best.alias("best"))
             .select("host", "path", "best.rule", "best.verdict"))
    return split.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def judge_urls_sql(rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH rules(verdict, h, p) AS (VALUES {rows}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
               row_number() OVER () AS n FROM pages),
parts AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                       'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT n, h || p AS rule, verdict,
                row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS place
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)"""
