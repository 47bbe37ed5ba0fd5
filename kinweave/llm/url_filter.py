"""Filters urls by rules and, where none fits, by a tree of path templates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import checkpoint

#: The rules of the query, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Templates of at most so many rows are broadcast to the pages (some 20 MB).
BROADCAST_TEMPLATES = 200_000


@dataclass(frozen=True)
class Settings:
    """z: a branch stays apart from its siblings if its labelled rate is so many standard errors away. strength: how many
    labelled urls the smoothing counts as. reject: least smoothed share of blocked urls of a rejected template."""

    z: float = 3.0
    strength: float = 8.0
    reject: float = 0.5


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none or the url is null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its text and its verdict, else null). A rule fits its host and all subdomains."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """The path's segments with plainly variable ones generalised to `*`: those with a digit in them, or long hexadecimal
    ones. A page suffix stays out (`12.html` is `*`)."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    return F.transform(parts, lambda s: F.when(s.rlike(r"[0-9]|^[0-9A-Fa-f-]{16,}$"), F.lit("*")).otherwise(s))


def _rate(bad: str, every: str) -> Column:
    return (F.col(bad) + 0.5) / (F.col(every) + 1.0)


def grow(paths: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, parts, template, labelled, blocked for distinct (host, parts) rows with those counts.

    Level by level from the root. A node (host and template so far) whose labelled urls all agree, or that has none, can't
    be told apart any further and is a leaf, `/**`. Of other nodes' children those whose labelled rate stands out from the
    rate of all siblings keep a branch each, however many siblings there are; the rest is merged into `*`. The number of
    levels is that of the longest path along which verdicts are mixed; each level is written to the shared folder.
    """
    open_, done, level = paths.withColumn("template", F.lit("")), [], 0
    while True:
        level += 1
        node = open_.groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        at = open_.join(node, ["host", "template"]).withColumn("segment", F.try_element_at("parts", F.lit(level)))
        at = checkpoint(at.withColumn("mixed", (F.col("all_blocked") > 0) & (F.col("all_blocked") < F.col("all_labelled"))))
        leaf = F.when(F.col("mixed"), F.col("template")).otherwise(F.concat("template", F.lit("/**")))
        done.append(at.filter("not mixed or segment is null").withColumn("template", leaf).select("host", "parts", "template", "labelled", "blocked"))
        at = at.filter("mixed and segment is not null")
        if at.isEmpty():
            break
        child = at.filter("segment <> '*'").groupBy("host", "template", "segment", "all_labelled", "all_blocked").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        pooled = _rate("all_blocked", "all_labelled")
        error = F.sqrt(pooled * (1 - pooled) / F.greatest(F.col("labelled"), F.lit(1)))
        apart = (F.col("labelled") > 0) & (F.abs(_rate("blocked", "labelled") - pooled) > settings.z * error)
        kept = child.filter(apart).select("host", "template", "segment", F.lit(True).alias("kept"))
        name = F.when(F.col("kept"), F.col("segment")).otherwise(F.lit("*"))
        open_ = at.join(kept, ["host", "template", "segment"], "left").select("host", "parts", F.concat("template", F.lit("/"), name).alias("template"), "labelled", "blocked")
    return reduce(DataFrame.unionByName, done)


def purity(tree: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, template, purity: the share of blocked urls among a template's labelled ones, smoothed towards the lesser of its
    host's share (itself smoothed towards all urls') and all urls'. So a template without labels of its own isn't rejected
    for what its host's other templates are, unless most urls are."""
    everywhere = tree.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    share = everywhere.select(((F.coalesce("blocked", F.lit(0)) + 1.0) / (F.coalesce("labelled", F.lit(0)) + 2.0)).alias("share"))
    smooth = lambda prior: (F.sum("blocked") + settings.strength * prior) / (F.sum("labelled") + settings.strength)
    all_ = share.first()["share"]
    host = tree.groupBy("host").agg(smooth(F.lit(all_)).alias("host_share"))
    prior = F.least(F.col("host_share"), F.lit(all_))
    found = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).join(host, "host")
    return found.select("host", "template", ((F.col("blocked") + settings.strength * prior) / (F.col("labelled") + settings.strength)).alias("purity"))


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity; a row for each page.

    ``labels`` (page_id, blocked boolean) tells which pages are labelled, null ids and null labels not; of several labels
    of a page, one that says blocked wins. Without ``labels`` the urls that a rule decides are the labelled ones. A rule's
    verdict holds; else a url is blocked if its template's smoothed share of blocked urls reaches ``settings.reject``. A
    null url, or one without `://`, has an empty host and path, and is judged by those; repeated rows count each. An
    empty table gives no rows; other columns aren't read.

    The tree is built from distinct generalised paths. It goes to the pages by broadcast if its size allows, else by a
    join whose pages Spark splits where a host's path has too many (adaptive skew join).
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict, "parts": segments(F.col("path"))})
    if labels is None:
        rows = rows.withColumn("blocked", F.when(F.col("by_rule").isNotNull(), F.col("by_rule") == "block"))
    else:
        known = labels.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max(F.col("blocked").cast("boolean")).alias("blocked"))
        rows = rows.join(known, "page_id", "left")
    paths = rows.groupBy("host", "parts").agg(F.count("blocked").alias("labelled"), F.count(F.when(F.col("blocked"), 1)).alias("blocked"))
    tree = checkpoint(grow(checkpoint(paths), settings))
    known = checkpoint(tree.select("host", "parts", "template").join(purity(tree, settings), ["host", "template"]))
    known = F.broadcast(known) if known.count() <= BROADCAST_TEMPLATES else known
    out = rows.drop("blocked").join(known, ["host", "parts"])
    by_tree = F.when(F.col("purity") >= settings.reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), "template", "purity")
