"""URL filter rules: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, exact confirmation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ascii_lower, table

NAME = "op8_url_filter"
c, lit = F.col, F.lit
#: (host, path, verdict) of the registered query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"),
         ("org", "/es/", "block"))


def host_and_path(url):
    """Host: behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end."""
    return (ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), lit(""))),
            F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), lit("")))


def _labels(host):
    return F.length(host) - F.length(F.replace(host, lit("."), lit(""))) + 1


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict in columns `_url_host, _url_path, _url_rule, _url_verdict`.

    Each distinct URL is expanded only to the shapes (host labels, path length) that occur among the rules, hashed with
    SHA-256 and joined on the first 32 bits; the full digest decides. The longest rule wins, then the longer host, then block.
    A null URL, or one without `://`, has an empty host and path and gets the default verdict, as does any URL that no rule
    fits. Repeated URLs are judged once; repeated pages come out as often as they went in. No rules or no pages: every page
    gets the default, or no rows.
    """
    pages = pages.drop("_url_key", "_url_rule", "_url_verdict")  # columns of these names are replaced
    digest = F.sha2(F.concat(c("h"), c("p")), 256)
    ready = rules.select(ascii_lower(F.coalesce(c("host"), lit(""))).alias("h"), F.coalesce(c("path"), lit("")).alias("p"), c("verdict").alias("v"))
    ready = ready.where(F.length("h") > 0).withColumn("digest", digest).select(
        F.substring("digest", 1, 8).alias("key"), c("digest").alias("rule_digest"), F.concat("h", "p").alias("rule"), c("v").alias("verdict"),
        _labels(c("h")).alias("labels"), F.length("p").alias("prefix"), F.length("h").alias("host_len"))
    shapes = ready.agg(F.collect_set(F.struct("labels", "prefix"))).scalar()
    host, path = host_and_path(c("url"))
    urls = pages.select(c(url).alias("url")).where(c("url").contains("://")).distinct().select("url", host.alias("host"), path.alias("path"))
    fits = lambda s: (s["labels"] <= _labels(c("host"))) & (s["prefix"] <= F.length("path"))
    one = urls.withColumn("shapes", shapes).select("url", "host", "path", F.explode(F.filter("shapes", fits)).alias("s"))
    suffix = F.expr("substring_index(host, '.', -s.labels)")
    one = one.select("url", F.sha2(F.concat(suffix, F.expr("substring(path, 1, s.prefix)")), 256).alias("digest"))
    hits = one.withColumn("key", F.substring("digest", 1, 8)).join(ready, "key").where(c("digest") == c("rule_digest"))
    best = hits.groupBy("url").agg(F.max(F.struct(F.length("rule"), "host_len", (c("verdict") == "block").alias("stop"), "rule", "verdict")).alias("best"))
    best = best.select(c("url").alias("_url_key"), c("best.rule").alias("_url_rule"), c("best.verdict").alias("_url_verdict"))
    host, path = host_and_path(c(url))
    return pages.join(best, pages[url] == best["_url_key"], "left").drop("_url_key").withColumns(
        {"_url_host": host, "_url_path": path, "_url_verdict": F.coalesce(c("_url_verdict"), lit(default))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", c("_url_host").alias("host"), c("_url_path").alias("path"),
                                                         c("_url_rule").alias("rule"), c("_url_verdict").alias("verdict"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH rules(h, p, v) AS (VALUES {_VALUES}),
parts AS (SELECT row_number() OVER () AS r, page_id,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM parts, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)
"""
