"""URL verdicts from host rules and, where none fits, a path-template tree per host.

Paths of a host are read as a tree of segments. Segments that vary (numbers, long hexadecimal names, or
children that are nearly all different) become wildcards, level by level. Branches are merged in two ways when
their labelled shares of blocked pages can't be told apart: those under one parent of a host, and those of
one template on several hosts. What a template has on all its hosts is what its purity on one host is smoothed
towards, so a host without labelled pages of its own is judged by the merged branch of others; where hosts
differ, nothing is merged and the prior stands. A template is rejected when its smoothed purity, the share of
blocked pages among its labelled ones, reaches a threshold.

Everything is counted on (host, shaped path) groups; pages meet their template again by one join. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registry_jobs.llm.common import dropped, join_counted, written

#: (host, path, verdict) of the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


STAR = r"^(?:[0-9]+|[0-9a-f]*[0-9][0-9a-f]{7,}|[0-9a-f-]{32,})(?:\.[A-Za-z0-9]{1,5})?\z"


def shaped(path: Column) -> Column:
    """All segments of a path: numbers and hexadecimal names of 8 and more are *."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(STAR), F.lit("*")).otherwise(s))


def varied_levels(paths: DataFrame, least_children: int) -> list[int]:
    """The levels, from 0, at which a host has more than least_children different segments: no other can be wide."""
    found = paths.select("host", F.posexplode("shape").alias("level", "child")).distinct()
    wide = found.groupBy("host", "level").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > least_children)
    return sorted(r.level for r in wide.select("level").distinct().collect())


def template_tree(paths: DataFrame, most_share: float, least_children: int) -> DataFrame:
    """paths (host, shape, n, labelled, blocked) with `template`: variable children made wildcards, from the top down.

    A parent's children are variable when it has more than least_children of them and more than
    most_share of its pages' number. One pass a level that may be wide, down to the longest path's end,
    on groups and not on pages; the segments between are taken as they are.
    """
    tree, done = paths.withColumn("template", F.lit("")), 0

    def plain(first: int, n: Column) -> Column:
        return F.concat("template", F.array_join(F.transform(F.slice("shape", first + 1, n), lambda s: F.concat(F.lit("/"), s)), ""))

    for k, level in enumerate(varied_levels(paths, least_children)):
        tree = tree.withColumn("template", plain(done, F.lit(level - done)))
        done = level + 1
        here = F.get("shape", F.lit(level))
        children = tree.where(here.isNotNull()).groupBy("host", "template", here.alias("child")).agg(F.sum("n").alias("n"))
        wide = (
            children.groupBy("host", "template")
            .agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("pages"))
            .where((F.col("kinds") > least_children) & (F.col("kinds") > F.col("pages") * most_share))
            .select("host", "template", F.lit(True).alias("wide"))
        )
        tree = tree.join(wide.hint("merge"), ["host", "template"], "left")
        step = F.when(F.col("wide"), F.lit("*")).otherwise(here)
        tree = tree.withColumn("template", F.when(here.isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step))).drop("wide")
        if k % 4 == 3:
            tree = written(tree)  # a plan doubles with each level
    return tree.withColumn("template", plain(done, F.size("shape")))


def alike(labelled: Column, blocked: Column, all_labelled: Column, all_blocked: Column, z: float) -> Column:
    """Whether a labelled branch's share is within z standard errors of that of the branches it may merge with."""
    share = F.try_divide(all_blocked, all_labelled)
    return (labelled > 0) & (F.abs(F.try_divide(blocked, labelled) - share) <= z * F.sqrt(F.try_divide(share * (1 - share), labelled)))


def merged_templates(leaf: DataFrame, prior: float, strength: float, z: float) -> DataFrame:
    """(template, toward): the smoothed purity of the templates whose hosts can't be told apart, from (host, template, labelled, blocked).

    Hosts differ when the chi-square of their shares is beyond its mean by z standard deviations.
    """
    known = leaf.where("labelled > 0").groupBy("template").agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("labelled").alias("n"), F.sum("blocked").alias("b"), F.sum(F.col("blocked") * F.col("blocked") / F.col("labelled")).alias("q")
    )
    share = F.col("b") / F.col("n")
    chi_square = F.coalesce(F.try_divide(F.col("q") - F.col("b") * share, share * (1 - share)), F.lit(0.0))
    free = F.col("hosts") - 1
    return known.where(chi_square <= free + z * F.sqrt(2.0 * free)).select("template", ((F.col("b") + strength * prior) / (F.col("n") + strength)).alias("toward"))


def judge_urls(pages: DataFrame, rules=RULES, most_share: float = 0.3, least_children: int = 8, prior: float = 0.3, strength: float = 4.0, reject_at: float = 0.5, z: float = 1.96) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row per row of pages (page_id, url).

    Rules decide where one fits, the longest, and of equally long ones the last by host and path; they label
    their pages for the tree. A null url or one without :// has an empty host and path. Paths are read to their
    ends. Null ids and repeated rows pass through, and each repeated row counts; other columns are not read; an
    empty table gives an empty result. purity is null where a rule decides. A template without labelled pages
    on its host has the purity of its hosts together, or the prior where these differ or have none.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    base = base.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    base = base.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shaped(F.col("path")))
    ruled = F.col("by_rule").isNotNull()
    counts = written(
        base.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ruled, 1)).alias("labelled"), F.count(F.when(F.col("by_rule.verdict") == "block", 1)).alias("blocked"))
    )
    tree = written(template_tree(counts, most_share, least_children))
    leaf = written(tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).withColumn("parent", F.regexp_replace("template", "/[^/]*\\z", "")))
    siblings = leaf.groupBy("host", "parent").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    both = leaf.join(siblings.hint("merge"), ["host", "parent"]).join(merged_templates(leaf, prior, strength, z).hint("merge"), "template", "left")
    merge = alike(F.col("labelled"), F.col("blocked"), F.col("all_labelled"), F.col("all_blocked"), z)
    n, b = F.when(merge, F.col("all_labelled")).otherwise(F.col("labelled")), F.when(merge, F.col("all_blocked")).otherwise(F.col("blocked"))
    judged = both.select("host", "template", ((b + strength * F.coalesce("toward", F.lit(prior))) / (n + strength)).alias("purity"))
    known = written(tree.join(judged.hint("merge"), ["host", "template"]).select("host", "shape", "template", "purity", F.col("n").alias("times")))
    total = known.agg(F.sum("times")).first()[0] or 0
    dropped(counts, leaf)
    return join_counted(base, known, ["host", "shape"], total, "left").select(
        "page_id",
        "host",
        "path",
        F.col("by_rule.rule").alias("rule"),
        F.coalesce("by_rule.verdict", F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
        F.when(~ruled, F.round("purity", 6)).alias("purity"),
    )
