"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_hot

#: Hex digits of a digest that rules and expressions are joined on.
PREFIX = 8


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added; columns of such names are replaced.

    pages has url, rules has host, path and verdict (host in small letters). A rule fits its host and all subdomains where the path
    starts with the rule's; the longest fitting rule (host and path together) wins, of equally long ones block, then the
    first by text. Where none fits, rule is null and verdict the default. All suffixes of a host at its dots that have as
    many labels as some rule's host, and all path prefixes of a length that some rule has, are tried, so none is missed.

    A null url, or one without ://, has an empty host and path, which only a rule of empty host and path fits. Rules with a null are
    left out and repeated ones count once; repeated pages are judged alike. Each distinct host and path is judged once,
    and each expression meets the rules once, however many of them make it. An empty table gives an empty one, and without rules all get the default.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).select("host", "path", "verdict").distinct()
    rules = rules.select(F.concat("host", "path").alias("rule"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"), "verdict", F.length("path").alias("n"), F.size(F.split("host", r"\.", -1)).alias("labels"))
    lengths = sorted(r.n for r in rules.select("n").distinct().collect())  # one for each length of a path
    labels = sorted(r.labels for r in rules.select("labels").distinct().collect())  # one for each number of labels
    own = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not lengths:
        return own.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    dots = F.size(F.split("host", r"\.", -1))
    there = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    hosts = there([F.when(dots >= n, F.substring_index("host", ".", -n)) for n in labels])
    paths = there([F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    judged = own.groupBy("host", "path").agg(F.count("*").alias("n"))
    tried = judged.withColumn("of_host", F.explode(hosts)).withColumn("of_path", F.explode(paths))
    tried = tried.select("host", "path", F.col("n").alias("pages"), F.sha2(F.concat_ws("\n", "of_host", "of_path"), 256).alias("tried"))
    asked = tried.groupBy("tried").agg(F.count("*").alias("n")).withColumn("prefix", F.substring("tried", 1, PREFIX))
    hits = asked.join(rules.select("rule", "verdict", "digest", F.substring("digest", 1, PREFIX).alias("prefix")), "prefix").where("tried = digest")
    hits = hits.groupBy("tried", "n").agg(F.min(F.struct((F.col("verdict") != "block").alias("later"), "rule", "verdict")).alias("hit"))
    fits = join_hot(tried, hits, ["tried"], [F.col("host"), F.col("path")])
    best = fits.groupBy("host", "path", "pages").agg(F.min(F.struct((-F.length("hit.rule")).alias("n"), "hit.later", "hit.rule", "hit.verdict")).alias("best"))
    best = best.select("host", "path", F.col("pages").alias("n"), "best.rule", "best.verdict")
    others = [F.col(f"`{c}`") for c, kind in own.dtypes if "map<" not in kind and "variant" not in kind]
    out = join_hot(own, best, ["host", "path"], others, how="left").drop("n")
    return out.select(*own.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT p.page_id, r.h, r.p, r.v FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) GROUP BY 1)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""
