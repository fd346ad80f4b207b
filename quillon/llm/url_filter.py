"""URL filter with a path-template tree, in DataFrame operations only.

A url is split into host and path; listed rules come first, the longest wins.
Urls that no rule fits are judged by their template:

1. *Generalise.*  Path segments that hold a digit become ``*`` (keeping a short file
   ending).  The tree of a host is built level by level from the root: a node with over
   ``max_children`` children that are mostly single pages gets one wildcard child
   instead, and the next level is counted under that, so that segments which vary below
   one another all become wildcards.  Pages are distinct paths, so that repeated rows
   change nothing.
2. *Merge.*  From the deepest level up, a child whose labelled share of good pages
   differs significantly from that of its siblings (two-proportion z test) is a branch of
   its own; the others are merged.  A node without such a child anywhere below it is one
   piece, and is compared with its own siblings in turn: so similar subtrees merge too.
3. *Judge.*  A branch's purity is its share of good pages, smoothed towards its host's,
   which is smoothed towards the overall share; below ``min_purity`` it is blocked.

Pages are counted by (host, generalised path) with partial aggregation before any tree
step, so the tree works on templates, not pages, with a few small tables for each of at
most LEVELS levels; the verdicts come back by a join that adaptive execution splits
where one host's template is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: (verdict, host, path): a rule fits its host and all subdomains.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Levels of a tree at most; what a path has beyond them is one segment.
LEVELS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as host plus path) and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # longest last: the outermost test
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def generalised(path: Column) -> Column:
    """Segments of a path, those with a digit as wildcards."""
    whole = F.split(path, "/")
    few = F.when(F.size(whole) > LEVELS, F.concat(F.slice(whole, 1, LEVELS - 1), F.array(F.array_join(F.slice(whole, F.lit(LEVELS), F.size(whole)), "/")))).otherwise(whole)
    return F.transform(few, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))


def templates(counts: DataFrame, max_children: int = 20) -> DataFrame:
    """(host, segments, names) of (host, segments, pages) rows: names are the segments with those of wide nodes as wildcards."""
    deepest = counts.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).first()[0]  # LEVELS at most
    tree = shared.write_and_read(counts.select("host", "segments", "pages", F.array().cast("array<string>").alias("names")), "tree")
    for level in range(deepest):
        deeper = F.size("segments") > level
        child = F.get("segments", F.lit(level))
        children = tree.where(deeper).groupBy("host", "names", child.alias("child")).agg(F.sum("pages").alias("pages"))
        nodes = children.groupBy("host", "names").agg(F.count(F.lit(1)).alias("children"), F.sum("pages").alias("all"))
        wide = nodes.where((F.col("children") > max_children) & (2 * F.col("children") > F.col("all"))).select("host", "names", F.lit(True).alias("wide"))
        wide = shared.write_and_read(wide, "wide")  # a plain table, so that a hot node's join can be split
        named = F.concat("names", F.array(F.when(F.col("wide"), F.lit("*")).otherwise(child)))
        tree = shared.write_and_read(tree.join(wide, ["host", "names"], "left").select("host", "segments", "pages", F.when(deeper, named).otherwise(F.col("names")).alias("names")), "tree")
    return tree.select("host", "segments", "names")


def branches(leaves: DataFrame, z: float = 1.96) -> DataFrame:
    """(host, names, n, g) rows with the branch that each template belongs to: ``own`` (whether it begins at a node that is apart) and ``path``.

    A branch is a node that differs from its siblings, or what is left of a node's
    children beside such ones, or a whole host.
    """
    deepest = leaves.agg(F.coalesce(F.max(F.size("names")), F.lit(0))).first()[0]
    open_ = F.lit(None).cast("boolean")
    state = shared.write_and_read(leaves.select("host", "names", "n", "g", F.col("names").alias("node"), open_.alias("own"), F.lit("").alias("path")), "branches")
    n, g, rest_n, rest_g = F.col("n"), F.col("g"), F.col("all_n") - F.col("n"), F.col("all_g") - F.col("g")
    pooled = F.col("all_g") / F.col("all_n")
    differs = F.abs(g / n - rest_g / rest_n) > z * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / rest_n))
    apart = F.when((n > 0) & (rest_n > 0), differs).otherwise(F.lit(False))
    for level in range(deepest, 0, -1):
        up = lambda c: F.slice(c, 1, level - 1)  # noqa: B023, E731
        nodes = state.where(F.col("own").isNull() & (F.size("node") == level)).groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).withColumn("parent", up("node"))
        parents = nodes.groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("g").alias("all_g"))
        nodes = shared.write_and_read(nodes.join(parents, ["host", "parent"]).select("host", "parent", "node", apart.alias("apart")), "nodes")
        closed = state.where(F.col("own").isNotNull() & (F.size("names") >= level)).select("host", up("names").alias("parent"))
        mixed = closed.unionByName(nodes.where("apart").select("host", "parent")).distinct().withColumn("mixed", F.lit(True))
        own = F.when(F.col("apart"), F.lit(True)).when(F.col("mixed"), F.lit(False))
        found = nodes.join(mixed, ["host", "parent"], "left").select("host", "node", F.lit(True).alias("here"), own.alias("now"), F.array_join(F.when(F.col("apart"), F.col("node")).otherwise(F.col("parent")), "/").alias("at"))
        found = shared.write_and_read(found, "found")
        mine = F.col("here") & F.col("own").isNull()
        state = shared.write_and_read(
            state.join(found, ["host", "node"], "left").select(
                "host", "names", "n", "g", F.when(mine & F.col("now").isNull(), up("node")).otherwise(F.col("node")).alias("node"),
                F.when(mine, F.col("now")).otherwise(F.col("own")).alias("own"), F.when(mine & F.col("now").isNotNull(), F.col("at")).otherwise(F.col("path")).alias("path"),
            ),
            "branches",
        )
    return state.select("host", "names", "n", "g", F.coalesce("own", F.lit(False)).alias("own"), "path")


def template_verdicts(counts: DataFrame, max_children: int = 20, weight: float = 5.0, min_purity: float = 0.6, z: float = 1.96) -> DataFrame:
    """Verdicts of (host, segments, pages, labelled, good) rows, one for each host and segments."""
    named = templates(counts, max_children)
    leaves = counts.join(named, ["host", "segments"]).groupBy("host", "names").agg(F.sum("labelled").alias("n"), F.sum("good").alias("g"))
    known = branches(leaves, z)
    hosts = known.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("g").alias("host_g"))
    overall = known.agg(((F.coalesce(F.sum("g"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("overall")).scalar()
    merged = known.groupBy("host", "own", "path").agg(F.sum("n").alias("branch_n"), F.sum("g").alias("branch_g"))
    base = (F.col("host_g") + weight * overall) / (F.col("host_n") + weight)
    purity = (F.col("branch_g") + weight * base) / (F.col("branch_n") + weight)
    judged = merged.join(hosts, "host").select("host", "own", "path", purity.alias("purity"))
    by_template = known.join(judged, ["host", "own", "path"]).select("host", "names", "purity")
    verdict = F.when(F.col("purity") < min_purity, "block").otherwise("allow").alias("verdict")
    return named.join(by_template, ["host", "names"]).select("host", "segments", F.array_join("names", "/").alias("template"), "purity", verdict)


def filter_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, **judging) -> DataFrame:
    """Judge every url: by the longest fitting rule, else by its template's purity.

    labels: (page key, good) where the key is the number in the url's path that the
    labelled table uses, and good is 0 or 1; keys that repeat are averaged.
    Returns page_id, host, path, template, purity, rule and verdict (allow or block).

    Defined cases: a null url, or one without ``://``, has empty host and path and
    is judged by the template of those; unlabelled templates get their host's
    smoothed share, and if nothing is labelled everything is allowed; null labels and keys are left out; repeated rows are judged
    alike; an empty table gives no rows; other columns of the inputs are ignored.
    """
    link = F.col(f"`{url}`").cast("string")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.coalesce(host_of(link), F.lit("")).alias("host"), F.coalesce(path_of(link), F.lit("")).alias("path"))
    rows = rows.withColumn("segments", generalised(F.col("path")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)")
    marks = labels.toDF("key", "good").where("key IS NOT NULL AND good IS NOT NULL").groupBy("key").agg(F.round(F.avg("good")).cast("long").alias("good"))
    paths = rows.select("host", "path", "segments").distinct()  # repeated urls are one page of the tree
    totals = paths.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("pages"), F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("good"))
    labelled = rows.select("host", "segments", number.alias("key")).join(marks, "key").groupBy("host", "segments").agg(F.lit(0).cast("long").alias("pages"), F.count(F.lit(1)).alias("labelled"), F.sum("good").alias("good"))
    counts = totals.unionByName(labelled).groupBy("host", "segments").agg(F.sum("pages").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    judged = shared.write_and_read(template_verdicts(counts, **judging).withColumnRenamed("verdict", "judged"), "templates")  # a plain table, so that a hot template's join can be split
    return rows.join(judged, ["host", "segments"]).select("page_id", "host", "path", "template", "purity", name.alias("rule"), F.coalesce(verdict, "judged").alias("verdict"))
