"""URL filters: pattern rules found by their rarest literal token.

A rule is a host, a path and a verdict. It fits its host and all subdomains of it, if the URL's path
starts with the rule's; `*` in the path stands for any characters, an empty host for any host.
Every rule is filed under one literal token that each URL it fits must hold, the one that fewest
URLs hold: a label of its host, or a whole segment of its path. A URL's own tokens fetch the rules
filed under them, and only those run as regular expressions. The longest rule that fits decides
(of equally long ones the last by text, and block before allow); without one the default does.

Host: what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower; path: what
follows up to `?`, `#` or the end. A null URL, or one without `://`, has neither: both are empty.
Repeated rows are judged each for itself. Rules without a verdict are left out; an empty rule table
gives every URL the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import ascii_lower

#: Rules above this many bytes are joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _tagged(parts: Column, kind: str) -> Column:
    return F.transform(F.array_remove(parts, ""), lambda x: F.concat(F.lit(kind), x))


def _url_tokens(host: Column, path: Column) -> Column:
    """Labels of the host, segments of the path, and the token of rules that have none."""
    parts = F.concat(_tagged(F.split(host, r"\."), "h:"), _tagged(F.split(path, "/"), "p:"), F.array(F.lit("")))
    return F.array_distinct(parts)


def _rule_tokens(host: Column, path: Column) -> Column:
    """Tokens that every fitting URL holds whole: a path's last piece may be cut, one with `*` may vary."""
    whole = F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda x: ~x.contains("*"))
    exact = F.filter(whole, lambda x: x != "")
    # behind a star it is open which segment stands where, but each still stands somewhere whole
    return F.array_distinct(F.concat(_tagged(F.split(host, r"\."), "h:"), _tagged(exact, "p:")))


def _regex(host: Column, path: Column) -> Column:
    literal = r"[\x00-\x7F&&[^A-Za-z0-9_/*]]"
    escaped = lambda c: F.regexp_replace(c, literal, r"\\$0")
    at_host = F.when(host == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), escaped(host)))
    return F.concat(F.lit("(?s)^"), at_host, F.lit("(?=/|$)"), F.regexp_replace(escaped(path), r"\*", ".*"))


def filed_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each rule with its regular expression and the token it is filed under. *urls*: host, path."""
    host, path = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    clean = rules.filter(F.col("verdict").isNotNull()).select(host.alias("host"), path.alias("path"), "verdict").distinct()
    listed = clean.select(
        F.concat("host", "path").alias("rule"), _regex(F.col("host"), F.col("path")).alias("regex"), "verdict",
        F.explode_outer(_rule_tokens(F.col("host"), F.col("path"))).alias("token"),
    ).withColumn("token", F.coalesce("token", F.lit("")))
    held = urls.select(F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = held.join(listed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"]
    return listed.join(counts, "token", "left").groupBy("rule", "regex", "verdict").agg(rarest.alias("token"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page row: page_id, host, path, rule (null if none fits), verdict."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    size = rules.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws("", "host", "path")) * 2 + 64), F.lit(0))).first()[0]
    filed = filed_rules(rules, urls)
    filed = F.broadcast(filed) if size <= broadcast_bytes else filed
    tokens = urls.select("host", "path", F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("token"))
    fits = tokens.join(filed, "token").filter(F.rlike(F.concat("host", "path"), F.col("regex")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
