"""URL filters as a sort-merge range join (DataFrame functions only).

A rule (host, path) covers its host, all subdomains, and all paths that begin with its path. With hosts written label by
label from the right ("org.example.www"), a rule is one interval of keys under its reversed host: those that begin with
its path. A url is looked up under each of its reversed host's levels for which rules exist. Under a level, the sorted
sweep passes interval starts and urls in one order; each start brings the stack of rules whose intervals hold it, so the
stack at a url is that of the last start, less the rules whose intervals have ended. Its top is the level's longest rule,
and the longest over all levels decides.

Hot levels (a domain may hold a third of all urls) are split: their urls are dealt over as many sweeps as their count
asks for, with the level's rules in each. Which levels are hot, at most MOST_HOT of them, is counted first. Urls are judged
once each; a page gets the verdict of a frequent url (at most MOST_HOT of them) by broadcast, of any other by a shuffle,
and a page without a host needs none.

Defined cases: a null url, or one without "://", has an empty host and path and gets the default verdict; an empty path
fits only a rule whose path is empty; rules without a host are ignored, a null rule path counts as empty; of equal rules
that disagree, block wins; repeated pages keep their rows; columns besides the id and url play no part; an empty table
gives an empty result, and no rules give the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, materialize

#: A hot level's urls are dealt over sweeps of about so many, but at least RULE_SHARE for each rule of the level.
ROWS_PER_SWEEP, RULE_SHARE = 500, 8
#: At most so many levels count as hot (their list is broadcast).
MOST_HOT = 10_000
#: Up to so many levels with rules, the list of levels is broadcast; beyond, it is joined by shuffling.
MOST_LEVELS = 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return ascii_lower(host), F.when(at > 0, path).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """level, start, stack: for each rule the rules of its level whose intervals hold its own, itself last."""
    host = ascii_lower(F.col("host"))
    one = rules.where(F.col("host").isNotNull()).select(reversed_host(host).alias("level"), F.coalesce("path", F.lit("")).alias("start"), F.concat(host, F.coalesce("path", F.lit(""))).alias("rule"), "verdict")
    one = one.groupBy("level", "start").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"))
    held = one.select("level", "start", F.explode(F.sequence(F.lit(0), F.length("start"))).alias("n")).select("level", "start", F.expr("left(start, n)").alias("outer"))
    outer = one.select("level", F.col("start").alias("outer"), F.struct(F.length("start").alias("n"), F.col("start").alias("path"), "rule", "verdict").alias("x"))
    return held.join(outer, ["level", "outer"]).groupBy("level", "start").agg(F.array_sort(F.collect_list("x")).alias("stack"))


def url_verdicts(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages."""
    host, path = split_url(F.col(url))
    seen = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))

    stacks = rule_stacks(rules)
    levels = stacks.groupBy("level").agg(F.count(F.lit(1)).alias("n_rules"), F.max(F.size(F.split("level", r"\.", -1))).alias("depth"))
    bound = levels.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth")).first()
    listed = F.broadcast(levels) if bound["n"] <= MOST_LEVELS else levels

    def under_levels(rows: DataFrame) -> DataFrame:
        parts = F.slice(F.reverse(F.split("host", r"\.", -1)), 1, bound["depth"])
        each = rows.where(F.col("host") != "").withColumn("parts", parts).select(*rows.columns, "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))
        return each.select(*rows.columns, F.array_join(F.slice("parts", F.lit(1), F.col("k")), ".").alias("level")).join(listed.select("level"), "level", "left_semi")

    nothing = F.lit(None).cast("string")
    if not bound["n"]:
        return seen.select("page_id", "host", "path", nothing.alias("rule"), F.lit(default).alias("verdict"))
    urls = materialize(seen.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")), "urls")
    counts = under_levels(seen.select("host")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sweep_rows = F.greatest(F.lit(ROWS_PER_SWEEP), RULE_SHARE * F.col("n_rules"))
    hot = counts.where(F.col("n") > max(ROWS_PER_SWEEP, total // MOST_HOT)).join(listed, "level").select("level", F.ceil(F.col("n") / sweep_rows).cast("int").alias("sweeps"))
    hot = F.broadcast(hot)

    probes = under_levels(urls.select("host", "path")).join(hot, "level", "left")
    probes = probes.select("level", F.coalesce(F.pmod(F.xxhash64("host", "path"), F.col("sweeps")), F.lit(0)).cast("int").alias("sweep"), F.col("path").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"), "host")
    starts = stacks.join(hot, "level", "left").withColumn("sweep", F.explode(F.sequence(F.lit(0), F.coalesce("sweeps", F.lit(1)) - 1)))
    starts = starts.select("level", "sweep", F.col("start").alias("key"), F.lit(0).alias("kind"), "stack", nothing.alias("host"))
    order = Window.partitionBy("level", "sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = starts.unionByName(probes).withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    fits = swept.withColumn("top", F.try_element_at(F.filter("stack", lambda x: F.startswith(F.col("key"), x["path"])), F.lit(-1))).where("top IS NOT NULL")
    best = fits.groupBy("host", F.col("key").alias("path")).agg(F.max(F.struct(F.length("top.rule").alias("n"), F.length("level").alias("m"), "top.rule", "top.verdict")).alias("best"))
    frequent = F.col("pages") > max(ROWS_PER_SWEEP, total // MOST_HOT)
    found = materialize(urls.join(best, ["host", "path"], "left").select("host", "path", frequent.alias("frequent"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")), "verdicts")
    few = F.broadcast(found.where("frequent").drop("frequent"))
    others = seen.where("host <> ''").join(few.select("host", "path"), ["host", "path"], "left_anti").join(found.where("NOT frequent AND rule IS NOT NULL").drop("frequent"), ["host", "path"], "left")
    out = ["page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")]
    bare = seen.where("host = ''").select("page_id", "host", "path", nothing.alias("rule"), F.lit(default).alias("verdict"))
    return seen.join(few, ["host", "path"]).select(*out).unionByName(others.select(*out)).unionByName(bare)
