"""robots.txt: its lines, the rules for all agents, and decisions about URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

TTL_SECONDS = 3600


def usable(raw: Column, status: Column) -> Column:
    """The text that counts: what was fetched with status 200; nothing means that all is allowed."""
    return F.when(status == 200, F.coalesce(raw, F.lit(""))).otherwise("")


def fresh(fetch_time: Column, now: Column) -> Column:
    return now - fetch_time <= TTL_SECONDS


def lines(robots: DataFrame) -> DataFrame:
    """domain, idx, name (lower-cased) and value of every directive."""
    split = robots.select("domain", F.posexplode(F.split(F.col("raw_content"), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("idx", "line"))
    bare = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    return split.select("domain", "idx", F.lower(F.trim(F.split_part(bare, F.lit(":"), F.lit(1)))).alias("name"), F.trim(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1)).alias("value"), bare.alias("line")).filter(F.contains("line", F.lit(":")))


def parsed(robots: DataFrame) -> DataFrame:
    """domain, crawl_delay (the first of any group), sitemaps, allowed and disallowed paths in order."""
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.when((F.col("name") == name) & (F.col("value") != ""), F.struct("idx", "value")))), lambda s: s["value"])
    delay = F.when(F.col("name") == "crawl-delay", F.split_part("value", F.lit(":"), F.lit(1)).try_cast("double"))
    found = lines(robots).groupBy("domain").agg(F.min_by(delay, F.when(delay.isNotNull(), F.col("idx"))).alias("crawl_delay"), listed("sitemap").alias("sitemaps"), listed("allow").alias("allowed"), listed("disallow").alias("disallowed"))
    none = F.array().cast("array<string>")
    return robots.select("domain").join(found, "domain", "left").select("domain", "crawl_delay", *(F.coalesce(c, none).alias(c) for c in ("sitemaps", "allowed", "disallowed")))


def rules(robots: DataFrame) -> DataFrame:
    """domain, idx, prefix, allow: the rules of the first group for all agents. An empty Disallow allows all."""
    given = lines(robots).withColumn("value", F.trim(F.split_part("value", F.lit("#"), F.lit(1))))
    kind = F.when(F.col("name") == "user-agent", "agent").when(F.col("name").isin("allow", "disallow"), "rule")
    order = Window.partitionBy("domain").orderBy("idx")
    some = given.withColumn("kind", kind).filter("kind is not null")
    starts = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(order), F.lit("rule")) == "rule")
    grouped = some.withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(order))
    agents = grouped.filter((F.col("kind") == "agent") & (F.col("value") == "*")).groupBy("domain").agg(F.min("group").alias("group"))
    own = grouped.filter("kind = 'rule'").join(agents, ["domain", "group"], "left_semi")
    free = (F.col("name") == "disallow") & (F.col("value") == "")
    return own.select("domain", "idx", F.when(free, "").otherwise(F.col("value")).alias("prefix"), (free | (F.col("name") == "allow")).alias("allow"))


def decisions(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """url and allowed: the first rule whose path the URL's begins with decides; without one it's allowed."""
    u = pages.select("url").distinct().withColumn("domain", urls.netloc(F.col("url")))
    target = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    u = u.withColumn("target", F.when(target == "", "/").otherwise(target))
    hit = u.join(rules(robots), "domain").filter(F.startswith("target", F.col("prefix"))).groupBy("url").agg(F.min_by("allow", "idx").alias("allow"))
    return u.join(hit, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))


def crawl_delay(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """url, crawl_delay and sitemaps of each page's domain; null and empty where it has none."""
    known = parsed(robots).select("domain", "crawl_delay", "sitemaps")
    u = pages.select("url").withColumn("domain", urls.netloc(F.col("url")))
    return u.join(known, "domain", "left").select("url", "crawl_delay", F.coalesce("sitemaps", F.array().cast("array<string>")).alias("sitemaps"))
