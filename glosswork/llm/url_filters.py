"""URL filters by a path-template tree.

Each host has a tree of path segments. A segment that is variable by its form (digits, hex, UUID, with or
without an extension) is generalised at once. Then the tree is walked from the root: at each
node the children that are rare, or whose share of bad labels does not differ from their siblings' by
a two-proportion test, are merged into one wildcard branch; a child that is well supported and
significantly different stays. A template's purity (the share of good labels) is smoothed towards its
host's, and the host's towards all hosts'. The limit is the purity of all labelled pages: a template is rejected when
the upper bound of its purity (BOUND standard deviations of its posterior) is under that, so that one with few
labels is rejected only for its host's sake.

The tree is built from counts of distinct paths, so a level costs one aggregation and one equi-join of
counts, and a hot host is split by path before it is summed. The walk ends where every branch holds one
path, which then is its own template to the end, however deep. Explicit rules come first: the longest
rule wins whose host is the URL's host or a parent domain and whose path is a prefix of the URL's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm.shared import small, written

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MOST_RULES = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUPPORT = 20
Z = 2.58
STRENGTH = 10.0
BOUND = 2.0
WILD = "*"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The struct (size, rule, verdict) of the longest rule that fits, or null. Rules are few and written
    into the plan; more than MOST_RULES are an error."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fitting = [
        F.when((host == h) | F.endswith(host, F.lit("." + h)), F.when(F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))))
        for h, p, v in rules
    ]
    return fitting[0] if len(fitting) == 1 else F.greatest(*fitting)


def segments(path: Column) -> Column:
    """The path's segments, variable ones in general form."""

    def general(s: Column) -> Column:
        s = F.regexp_replace(s, r"\A[0-9]+(?=\.[A-Za-z0-9]{1,5}\z|\z)", "<n>")
        s = F.regexp_replace(s, r"(?i)\A(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(?=[0-9a-f]*[0-9])[0-9a-f]{16,})(?=\.[a-z0-9]{1,5}\z|\z)", "<h>")
        return s

    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), general)


def grown(paths: DataFrame) -> DataFrame:
    """paths: host, segs, n, n_lab, n_bad, a row for each distinct value of the first two. Adds `template`. The
    result is a written table."""
    cur, done, level = paths.withColumn("template", F.lit("")), None, 0
    while True:
        level += 1
        # a branch with one path below it has its own template to the end
        alone = cur.groupBy("host", "template").agg(F.count(F.lit(1)).alias("paths"))
        rest = F.slice(F.col("segs"), F.lit(level), F.greatest(F.size("segs") - (level - 1), F.lit(0)))
        ended = F.size("segs") < level
        split = cur.join(alone, ["host", "template"]).withColumn("over", ended | (F.col("paths") == 1))
        whole = F.when(ended, F.col("template")).otherwise(F.concat("template", F.lit("/"), F.array_join(rest, "/")))
        split = written(split.select("host", "segs", "n", "n_lab", "n_bad", F.when(F.col("over"), whole).otherwise(F.col("template")).alias("template"), "over"), f"url-paths-{level}")
        finished = split.where("over").drop("over")
        done = finished if done is None else done.unionByName(finished)
        # the siblings are all that go on, and those of the node that end here don't count as children
        cur = split.where("NOT over").drop("over")
        if cur.isEmpty():
            break
        seg = F.get(F.col("segs"), level - 1)
        kids = cur.groupBy("host", "template", seg.alias("seg")).agg(*[F.sum(c).alias(c) for c in ("n", "n_lab", "n_bad")])
        # totals of the siblings by aggregation, joined back: no window over a node of unbounded size
        sums = kids.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "n_lab", "n_bad")])
        kids = kids.join(sums, ["host", "template"])
        rest_n, rest_bad = F.col("all_n_lab") - F.col("n_lab"), F.col("all_n_bad") - F.col("n_bad")
        p = (F.col("all_n_bad") + 0.5) / (F.col("all_n_lab") + 1)
        gap = F.abs((F.col("n_bad") + 0.5) / (F.col("n_lab") + 1) - (rest_bad + 0.5) / (rest_n + 1))
        z = gap / F.sqrt(p * (1 - p) * (1 / (F.col("n_lab") + 1) + 1 / (rest_n + 1)))
        only = F.col("n") == F.col("all_n")
        own = only | ((F.col("n_lab") >= SUPPORT) & (z >= Z))
        kids = written(kids.where(own).select("host", "template", "seg"), f"url-level-{level}")
        cur = cur.withColumn("seg", seg).join(small(kids.withColumn("own", F.lit(True))), ["host", "template", "seg"], "left")
        step = F.concat("template", F.lit("/"), F.when(F.col("own"), F.col("seg")).otherwise(F.lit(WILD)))
        cur = cur.select("host", "segs", "n", "n_lab", "n_bad", step.alias("template"))
    return written(done, "url-tree")


def purity(templates: DataFrame, bound: float = BOUND) -> DataFrame:
    """host, template, their smoothed purity and whether they are rejected, from rows with n_lab and n_bad."""
    by_host = templates.groupBy("host").agg(F.sum("n_lab").alias("h_lab"), F.sum("n_bad").alias("h_bad"))
    every = by_host.agg(F.coalesce(F.sum("h_lab"), F.lit(0)).alias("a_lab"), F.coalesce(F.sum("h_bad"), F.lit(0)).alias("a_bad"))
    by_host = by_host.crossJoin(F.broadcast(every))  # one row of totals
    base = 1 - (F.col("a_bad") + 0.5) / (F.col("a_lab") + 1)
    by_host = by_host.select("host", base.alias("base"), ((F.col("h_lab") - F.col("h_bad") + STRENGTH * base) / (F.col("h_lab") + STRENGTH)).alias("h_purity"))
    own = templates.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "n_lab", "n_bad")])
    own = own.join(by_host, "host").withColumn("purity", (F.col("n_lab") - F.col("n_bad") + STRENGTH * F.col("h_purity")) / (F.col("n_lab") + STRENGTH))
    upper = F.col("purity") + bound * F.sqrt(F.col("purity") * (1 - F.col("purity")) / (F.col("n_lab") + STRENGTH + 1))
    return own.withColumn("rejected", upper < F.col("base"))


ADDED = ("host", "path", "template", "purity", "rule", "verdict")


def judged(pages: DataFrame, bad: Column, url_col: str = "url", rules=RULES, bound: float = BOUND, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """keep's columns, host, path, template, purity, rule and verdict of every row of pages.

    bad: whether a row's page is known to be bad (boolean; null where it has no label).
    Defined cases: a null URL or one without :// has an empty host and path and the template ''; repeated
    rows count each and are judged each; an empty table stays empty; only the columns in keep return, and one
    named like an added column is replaced by that.
    """
    keep = [c for c in keep if c not in ADDED]
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    own = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    rows = pages.select(*own, host.alias("__host"), path.alias("__path"), bad.cast("int").alias("__bad"))
    rows = rows.withColumn("__segs", segments(F.col("__path")))
    paths = rows.groupBy(F.col("__host").alias("host"), F.col("__segs").alias("segs")).agg(
        F.count(F.lit(1)).alias("n"), F.count("__bad").alias("n_lab"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("n_bad")
    )
    tree = grown(written(paths, "url-paths"))
    scores = purity(tree, bound).select("host", "template", "purity", "rejected")
    verdicts = written(tree.join(scores, ["host", "template"]).select(F.col("host").alias("__host"), F.col("segs").alias("__segs"), "template", "purity", "rejected"), "url-verdicts")
    out = rows.drop("__bad").join(small(verdicts), ["__host", "__segs"], "left")
    out = out.withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules))
    mine = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    back = [F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*back, F.col("__host").alias("host"), F.col("__path").alias("path"), "template", "purity", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), mine).alias("verdict"))
