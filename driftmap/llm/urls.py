"""URL filters: explicit rules first, then a path-template tree judged by labelled purity; DataFrame functions only.

A rule such as ``example.com/en/`` fits its host and all subdomains where the path starts with the rule's; the longest
rule wins. Labels come from three sources, the first that says something counts: a column of known labels, a list of unwanted words that
stand as a whole word in the host or path, and the rules' own verdicts. For urls without a rule each host has a tree of path segments. Segments' numbers and long hex strings become
``#``; level by level, down to where paths no longer share a prefix, branches of a node whose labelled rates of blocking do not differ significantly from their
siblings' (two-proportion z test) are merged into ``*``; branches without labels say nothing of the labelled ones and
are merged among themselves, into ``?``. Where the segment is variable (at least FAN branches, and on average no more pages
a branch than there are branches; labels play no part), a new branch is one more value of it: if two or more labelled
branches are merged there, those without labels join their ``*`` and have its purity. A template is rejected if its purity, (blocked + s * g) /
(labelled + s) with the corpus rate g, reaches a limit; a template with no labels has purity g and is never rejected.

Edge cases: null urls and urls without :// have empty host and path and no rule; a null label is no evidence; repeated
rows each count and each get a verdict; an empty table gives an empty result; only id and url are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, small, written

#: Branches of a node from which its segment can count as variable.
FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that mark a url as unwanted, by default; a configuration.
UNWANTED = ("ads", "adult", "bets", "casino", "pills", "spam")


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host (A-Z lower-cased) and path."""
    has = F.coalesce(F.instr(F.col(url), "://"), F.lit(0)) > 0
    df = df.withColumn("__rest", F.when(has, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(""))
    df = df.withColumn("host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    df = df.withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(host) + 1)"), "^[^?#]*", 0))
    return df.withColumn("host", F.translate("host", UPPER, LOWER)).drop("__rest")


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its action) for the columns host and path; rules: (allow or block, host and path prefix), a configuration of at most some hundreds."""
    found, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        found, action = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(act)).otherwise(action)
    return found, action


def generalised(path: Column) -> Column:
    """The path's segments with variable parts as #."""
    own = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(own, lambda x: F.regexp_replace(x, "[0-9A-Fa-f]{8,}(-[0-9A-Fa-f]+)*|[0-9]+", "#"))


def has_word(words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in host or path, between characters other than letters and digits."""
    own = F.split(F.lower(F.concat_ws("/", "host", "path")), "[^a-z0-9]+")
    return F.arrays_overlap(own, F.array(*[F.lit(w) for w in words])) if words else F.lit(False)


def merged_level(tree: DataFrame, level: int, z_limit: float) -> DataFrame | None:
    """tree (host, raw, segments, pages, labelled, blocked) with similar branches at this level merged into *; None if no two paths share a node here or below."""
    tree = tree.withColumn("__up", F.concat_ws("/", F.slice("segments", 1, level))).withColumn("__seg", F.get("segments", F.lit(level)))
    nodes = tree.where(F.col("__seg").isNotNull()).groupBy("host", "__up", "__seg").agg(F.count("*").alias("paths"), F.sum("pages").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    nodes = written(nodes, "nodes")
    parents = written(nodes.groupBy("host", "__up").agg(F.count("*").alias("fan"), F.sum("paths").alias("paths"), F.sum("n").alias("all_n"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b")).where("paths > 1").drop("paths"), "parents")
    if not parents.limit(1).count():
        return None
    other = F.col("all_l") - F.col("l")
    pooled = F.col("all_b") / F.col("all_l")
    spread = pooled * (1 - pooled) * (1 / F.col("l") + 1 / other)
    differ = F.col("b") / F.col("l") - (F.col("all_b") - F.col("b")) / other
    alike = F.when((F.col("l") == 0) | (other == 0) | (F.col("all_b") == 0) | (F.col("all_b") == F.col("all_l")), F.lit(True)).otherwise(differ * differ < z_limit * z_limit * spread)
    merging = written(nodes.join(parents, ["host", "__up"]).where((F.col("fan") > 1) & alike), "alike")
    variable = (F.col("fan") >= FAN) & (F.col("all_n") <= F.col("fan") * F.col("fan"))
    shared = merging.where(variable & (F.col("l") > 0)).groupBy("host", "__up").count().where("count > 1").select("host", "__up", F.lit(True).alias("__shared"))
    own = merging.join(small(written(shared, "shared")), ["host", "__up"], "left")
    merge = written(own.select("host", "__up", "__seg", F.when((F.col("l") == 0) & F.col("__shared").isNull(), "?").otherwise("*").alias("__merge")), "merge")
    tree = tree.join(small(merge), ["host", "__up", "__seg"], "left")
    star = F.transform("segments", lambda x, k: F.when(k == level, F.col("__merge")).otherwise(x))
    tree = written(tree.withColumn("segments", F.when(F.col("__merge").isNotNull(), star).otherwise(F.col("segments"))).drop("__up", "__seg", "__merge"), "tree")
    released(nodes, parents, merging, merge)
    return tree


def judged(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", label: str | None = None, words: tuple[str, ...] = UNWANTED, z_limit: float = 1.96, smoothing: float = 5.0, limit: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each page.

    label: a column that is true for pages known to be unwanted and false for those known to be wanted.
    """
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), (F.col(label) if label else F.lit(None)).cast("boolean").alias("__label"))
    df = url_parts(df).drop("url")
    rule, action = rule_of(rules)
    df = df.withColumn("rule", rule).withColumn("__action", action)
    df = df.withColumn("__label", F.coalesce("__label", F.when(has_word(words), F.lit(True)), F.col("__action") == "block"))
    df = written(df.withColumn("__raw", F.concat_ws("/", generalised(F.col("path")))), "urls")
    tree = df.groupBy("host", "__raw").agg(F.count("*").alias("pages"), F.count("__label").alias("labelled"), F.count(F.when(F.col("__label"), 1)).alias("blocked"))
    tree = written(tree.withColumn("segments", F.split("__raw", "/")), "tree")
    labelled, blocked = tree.agg(F.sum("labelled"), F.sum("blocked")).first()
    rate = (blocked or 0) / labelled if labelled else 0.0
    level = 0
    while (merged := merged_level(tree, level, z_limit)) is not None:
        released(tree)
        tree, level = merged, level + 1
    tree = tree.withColumn("template", F.concat(F.lit("/"), F.concat_ws("/", "segments")))
    purity = tree.groupBy("host", "template").agg(((F.sum("blocked") + smoothing * rate) / (F.sum("labelled") + smoothing)).alias("purity"), (F.sum("labelled") > 0).alias("__known"))
    known = written(tree.select("host", "__raw", "template").join(written(purity, "purity"), ["host", "template"]), "templates")
    df = df.join(small(known), ["host", "__raw"], "left")
    verdict = F.coalesce("__action", F.when(F.col("__known") & (F.col("purity") >= limit), "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
