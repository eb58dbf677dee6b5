"""URL verdicts: listed rules first, then trust and distrust spread over the host graph.

Hosts are linked by the absolute links in their pages.  Trust is personalised PageRank from the
trusted seeds (hosts of pages that an allow rule fits) along the links; distrust is the same from
the blocked seeds along reversed links: who links to blocked hosts is suspect.  A host whose
distrust passes its trust by more than a threshold is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.workspace import Workspace

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
ROUNDS = 20
#: Share of all distrust by which a host's distrust must pass its trust to be blocked.
THRESHOLD = 1e-9


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule (verdict, rule) that fits, or null: its host or a subdomain, its path a prefix."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links): absolute links between different hosts, added up before they are dealt out."""
    host, _ = host_and_path(F.col(url))
    links = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    found = pages.select(host.alias("src"), F.explode(links).alias("link"))
    target, _ = host_and_path(F.regexp_replace(F.col("link"), r"^//", "http://"))
    found = found.select("src", target.alias("dst")).filter("src != '' AND dst != '' AND src != dst")
    return found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, work: Workspace, name: str, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank: (host, score) from (src, dst, links) edges and (host, seed) weights adding to 1.

    Hosts without out-links send their score back to the seeds.  Each round is written to the shared
    folder, so a lost executor costs one round; a round with no edges ends it.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    parts = work.save(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("part")), f"{name}-parts")
    if parts.isEmpty():
        return seeds.select("host", F.col("seed").alias("score"))
    now = seeds.select("host", F.col("seed").alias("score"))
    for k in range(rounds):
        moved = parts.join(now, F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.col("part") * F.col("score") * damping).alias("score"))
        kept = moved.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("s")).collect()[0]["s"]
        base = seeds.select("host", (F.col("seed") * (1.0 - kept)).alias("score"))
        last, now = now, work.save(moved.select(F.col("dst").alias("host"), "score").union(base).groupBy("host").agg(F.sum("score").alias("score")), f"{name}-{k}")
        changed = now.alias("x").join(last.alias("y"), "host", "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("x.score", F.lit(0.0)) - F.coalesce("y.score", F.lit(0.0)))), F.lit(0.0)).alias("c")).collect()[0]["c"]
        if changed < 1e-9:
            break
    return now


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) per row.

    A null url, or one without ``://``, has an empty host and path, no rule and the verdict allow.
    Null html has no links; null keys and repeated rows stay; other columns do not matter; an empty
    table gives an empty one.  Hosts that no seed reaches have trust and distrust 0: allow.
    """
    work = Workspace(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules))
    edges = work.save(host_edges(pages, url, html), "edges")
    seeds = judged.filter("hit IS NOT NULL AND host != ''").groupBy("host", F.col("hit.verdict").alias("verdict")).agg(F.count("*").cast("double").alias("pages"))
    seeds = work.save(seeds, "seeds")
    totals = {r["verdict"]: r["n"] for r in seeds.groupBy("verdict").agg(F.sum("pages").alias("n")).collect()}
    trusted = seeds.filter("verdict = 'allow'").select("host", (F.col("pages") / totals.get("allow", 1.0)).alias("seed"))
    blocked = seeds.filter("verdict = 'block'").select("host", (F.col("pages") / totals.get("block", 1.0)).alias("seed"))
    trust = spread(edges, trusted, work, "trust").select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = spread(back, blocked, work, "distrust").select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust"))
    scores = trust.union(distrust).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    # Only hosts with links are judged by them: seeds that no link touches say nothing of their other pages.
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    scores = scores.join(linked, "host", "left_semi")
    both = judged.join(scores, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    method = F.when(F.col("distrust") > F.col("trust") + threshold, F.lit("block")).otherwise(F.lit("allow"))
    return both.select(F.col("key").alias(key), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "trust", "distrust")
