"""URL filter by a path-template tree: per host, variable segments become wildcards, branches that are statistically alike
merge, and a template is rejected by its smoothed labelled purity. DataFrame operations only.

Tree: all segments of a path, however deep or long. A segment that holds a digit is variable ("*"). Level by level from the root, literal children
merge into "*" on two statistical grounds. Where the children of a node are surely (lower bound of a confidence interval) mostly of one page each,
as slugs are, those of one page do. And a child does whose labelled rate differs from the rate of its parent's subtree by less than Z standard
errors. A path that is alone in its node is finished at once, so there are as many levels as different paths share.
Purity of a template: (bad + SMOOTHING * prior) / (labelled + SMOOTHING), where the prior is the same quotient for the
template over all hosts, and that one's prior is the share of bad among all labels.

Rules come first: a rule fits its host and all subdomains where the path starts with the rule's path; the longest (host and
path together) wins, of equally long ones the first by verdict, host and path.

Defined cases: a null url, or one without "://", has an empty host and path, no rule, and is judged as the host ""; a
rule needs a path that begins with "/"; repeated rows get one result each; without labels every template has purity 0 and
is allowed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_or_plain, table

Z, SMOOTHING, REJECT, SINGLES = 1.96, 4.0, 0.5, 0.5
#: Rules of the query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: then up to "?", "#" or the end."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. rules is a short list of a configuration."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(longest):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Generalised segments of a path."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(r"\d"), "*").otherwise(s))


def template_tree(labelled: DataFrame, z: float = Z, singles: float = SINGLES) -> DataFrame:
    """host, raw_segments (a path's generalised segments), template, n, good and bad, from columns host, raw_segments and label (1 bad, 0 good, null).

    labelled is aggregated to distinct (host, raw_segments) first, with partial sums before the shuffle."""
    tree = labelled.groupBy("host", "raw_segments").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("good"))
    # Each level reads the tree twice, so it is written down once a level.
    tree = scratch(tree.withColumn("prefix", F.lit("")), "url-tree")
    columns = ["host", "raw_segments", "n", "good", "bad", "prefix"]
    finished, level = [], 0
    while not tree.isEmpty():
        ended = F.size("raw_segments") <= level
        nodes = tree.withColumn("segment", F.coalesce(F.get("raw_segments", F.lit(level)), F.lit("")))
        child = nodes.groupBy("host", "prefix", "segment").agg(F.sum("bad").alias("c_bad"), F.sum(F.col("bad") + F.col("good")).alias("c_n"), F.sum("n").alias("pages"), F.count("*").alias("c_paths"))
        # Children of one node: as many as a site has distinct literal segments, summed before they meet.
        alone = F.sum(F.when(F.col("pages") == 1, 1).otherwise(0)).alias("alone")
        parent = child.groupBy("host", "prefix").agg(F.sum("c_bad").alias("p_bad"), F.sum("c_n").alias("p_n"), F.sum("pages").alias("p_pages"), F.sum("c_paths").alias("paths"), alone)
        pooled = (F.col("p_bad") + 1) / (F.col("p_n") + 2)
        apart = F.abs(F.col("c_bad") / F.col("c_n") - pooled) > z * F.sqrt(pooled * (1 - pooled) / F.col("c_n"))
        k, n = F.col("alone"), F.col("p_pages")
        variable = (k + z * z / 2 - z * F.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z) >= singles
        slug = (F.col("pages") == 1) & variable
        # Where nothing is labelled nothing shows that branches are alike: literals that aren't slugs stay.
        merged = F.when(F.col("segment").isin("", "*"), F.col("segment")).when(slug | (F.col("c_n") > 0) & ~apart, "*").otherwise(F.col("segment"))
        decided = child.join(parent, ["host", "prefix"]).select("host", "prefix", "segment", merged.alias("as_segment"), (F.col("paths") == 1).alias("only"), (F.col("p_n") > 0).alias("known"))
        decided = scratch(decided, "url-nodes")
        moved = nodes.join(small_or_plain(decided, 200), ["host", "prefix", "segment"])
        # A path that is alone has its parent's rate at every node, so all of its segments merge if it has a label.
        rest = F.transform(F.slice("raw_segments", level + 1, F.greatest(F.size("raw_segments") - level, F.lit(0))), lambda s: F.concat(F.lit("/"), F.when(F.col("known"), "*").otherwise(s)))
        step = F.when(F.col("only"), F.array_join(rest, "")).when(F.col("as_segment") == "", "").otherwise(F.concat(F.lit("/"), "as_segment"))
        moved = scratch(moved.select("host", "raw_segments", "n", "good", "bad", F.concat("prefix", step).alias("prefix"), (F.col("only") | ended).alias("done")), "url-tree")
        finished.append(moved.filter("done").select(columns))
        tree, level = moved.filter("NOT done").select(columns), level + 1
    whole = functools.reduce(DataFrame.unionByName, finished, tree.limit(0).select(columns))
    return whole.select("host", "raw_segments", F.when(F.col("prefix") == "", "/").otherwise(F.col("prefix")).alias("template"), "n", "good", "bad")


def template_purity(tree: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """host, raw_segments, template and bad_share, smoothed towards the template's share over all hosts."""
    own = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("labelled"))
    everywhere = own.groupBy("template").agg(F.sum("bad").alias("t_bad"), F.sum("labelled").alias("t_n"))
    overall = own.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("labelled"), F.lit(0)), F.lit(1))).alias("share"))
    # One row, read once: the corpus-wide share of bad labels.
    share = float(overall.first()[0] or 0.0)
    prior = (F.col("t_bad") + smoothing * share) / (F.col("t_n") + smoothing)
    rated = own.join(everywhere, "template").select("host", "template", ((F.col("bad") + smoothing * prior) / (F.col("labelled") + smoothing)).alias("bad_share"))
    return tree.select("host", "raw_segments", "template").join(rated, ["host", "template"])


def judge(pages: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and bad_share of each row; labels are the verdicts of the rules."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("raw_segments", segments(F.col("path")))
    label = F.when(F.col("hit.verdict") == "block", 1).when(F.col("hit.verdict") == "allow", 0)
    rated = template_purity(template_tree(parsed.select("host", "raw_segments", label.alias("label"))))
    known = small_or_plain(rated, 400)
    verdict = F.coalesce("hit.verdict", F.when(F.col("bad_share") >= reject, "block").otherwise("allow"))
    return parsed.join(known, ["host", "raw_segments"], "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("bad_share", 6).alias("bad_share"))


def op10_template_tree_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
