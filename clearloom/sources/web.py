"""Web sources: compliance pre-filter, conditional fetch decisions, source registry and checkpoints."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGENT = "clearloom-bot/0.1"
META_TDM = r"""(?i)<meta[^>]+name=["']tdm-reservation["'][^>]+content=["'](1|true)["']"""
META_LICENSE = r"""(?i)<meta[^>]+name=["']license["'][^>]+content=["']([^"']+)["']"""


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """url, allowed: by the origin's robots.txt (origin, robots_txt); without one everything is allowed. A file is parsed once for a batch of its URLs."""
    origin = F.regexp_extract("url", r"^([^:]+://[^/]*)", 1)
    rows = urls.withColumn("origin", origin).join(robots.select("origin", "robots_txt"), "origin", "left")

    @F.pandas_udf("boolean")
    def allowed(url: pd.Series, text: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}

        def one(u: str, t: str | None) -> bool:
            if t is None:
                return True
            if t not in parsed:
                parsed[t] = RobotFileParser()
                parsed[t].parse(t.splitlines())
            return parsed[t].can_fetch(agent, u)

        return pd.Series([one(u, t) for u, t in zip(url, text)], dtype=bool)

    return rows.withColumn("allowed", allowed("url", "robots_txt")).drop("origin", "robots_txt")


def ai_txt_blocks(text: Column) -> Column:
    """Any line that begins with `Disallow: /` forbids everything."""
    return F.coalesce(F.exists(F.split(text, "\n"), lambda x: F.trim(x).startswith("Disallow: /")), F.lit(False))


def header_reserves(value: Column) -> Column:
    return F.coalesce(F.trim(value).isin("1", "true", "yes"), F.lit(False))


def page_reserves(html: Column) -> Column:
    return F.coalesce(F.substring(html, 1, 4097).rlike(META_TDM), F.lit(False))


def license_hint(html: Column, header: Column) -> Column:
    meta = F.regexp_extract(html, META_LICENSE, 1)
    return F.when(meta != "", meta).when(html.contains("creativecommons.org"), "Creative Commons").otherwise(header)


def prefilter(rows: DataFrame) -> DataFrame:
    """rows (robots_ok, ai_txt, tdm_header, html, license_header) with allowed, tdm_opted_out, license_hint, skip_reason; the first rule that fails decides."""
    ai, head, page = ai_txt_blocks(F.col("ai_txt")), header_reserves(F.col("tdm_header")), page_reserves(F.col("html"))
    reason = F.when(~F.col("robots_ok"), "robots.txt").when(ai, "ai.txt").when(head, "tdm-reservation header").when(page, "tdm-reservation meta")
    return rows.withColumns({"skip_reason": reason, "allowed": reason.isNull(), "tdm_opted_out": F.col("robots_ok") & (ai | head | page), "license_hint": license_hint(F.col("html"), F.col("license_header"))})


def conditional_fetch(targets: DataFrame, cache: DataFrame, responses: DataFrame) -> DataFrame:
    """url, if_none_match, status_code, is_modified, error: what a conditional GET with cached validators comes to, from recorded responses (url, etag, status_code)."""
    rows = targets.join(cache.select("url", F.col("etag").alias("if_none_match")), "url", "left").join(responses.select("url", F.col("etag").alias("now"), "status_code"), "url", "left")
    code = F.when(F.col("status_code").isNull(), 500).when((F.col("status_code") == 200) & (F.col("now") == F.col("if_none_match")), 304).otherwise(F.col("status_code"))
    rows = rows.withColumn("code", code)
    return rows.select("url", "if_none_match", F.col("code").alias("status_code"), (F.col("code") == 200).alias("is_modified"), F.when(~F.col("code").isin(200, 304), F.concat(F.lit("HTTP "), F.col("code"))).alias("error"))


def remaining(targets: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Targets (url, pos) that the checkpoint's crawled URLs lack, in order."""
    done = checkpoint.select(F.explode(F.from_json("crawled_urls", "array<string>")).alias("url"))
    return targets.join(done, "url", "left_anti").orderBy("pos")


def due_sources(sources: DataFrame) -> DataFrame:
    """Active sources, never crawled ones first, then the longest unvisited."""
    return sources.filter("active").orderBy(F.asc_nulls_first("last_crawled_at"), "source_id")


def list_sources(sources: DataFrame, active_only: bool = False) -> DataFrame:
    return (sources.filter("active") if active_only else sources).orderBy(F.desc("created_at"), "source_id")


def mark_crawled(sources: DataFrame, crawls: DataFrame) -> DataFrame:
    last = crawls.groupBy("source_id").agg(F.max("at").alias("at"))
    return sources.join(last, "source_id", "left").withColumn("last_crawled_at", F.coalesce("at", "last_crawled_at")).drop("at")


def delete_sources(sources: DataFrame, ids: DataFrame) -> DataFrame:
    return sources.join(ids, "source_id", "left_anti")


def spread_by_domain(urls: DataFrame, tasks: int, per_domain: int = 3) -> DataFrame:
    """URLs dealt so that at most `per_domain` tasks fetch from one domain."""
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return urls.withColumn("lane", F.pmod(F.xxhash64("url"), F.lit(per_domain))).repartition(tasks, host, "lane").drop("lane")


def upsert(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """state with new rows in the place of rows with their key; of several new ones the last by `seq`."""
    rows = state.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("_n"), F.desc("seq"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_n")
