"""URL rules by a sort-merge range join on canonical keys.

A host is turned round, label by label, so that a rule's host stands before those of its
subdomains, and a rule's path prefix is an interval of the paths under that host. Urls send one
probe to each of their host's suffixes that has rules. Probes and starts of rules are sorted
together by (reversed host, path) and swept: at each place the state is the stack of the rule that
started last, that is this rule and all rules whose intervals enclose it. Since intervals of
prefixes are nested or apart, every rule that covers a probe is on that stack, and those that ended
before it are told by their prefix not being one of its path.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Probes of one host in one sweep, about; hosts with more are swept in several lots.
LOT = 20_000
#: Between reversed labels: sorts before all that a host holds.
DOT = "\u0001"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there
    up to `?`, `#` or the end. Both empty where the url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substr(rest, F.length(host) + 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), DOT)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """`key` (reversed host), `path` and `stack` of each distinct start: the rules there and those
    that enclose them, outermost first.

    `rules`: `host`, `path`, `verdict`. Of rules with one host and path the last verdict in
    alphabetical order counts (so `block` beats `allow`).
    """
    clean = rules.where(F.col("host").isNotNull()).groupBy(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    ).agg(F.max("verdict").alias("verdict"))
    clean = clean.select("host", "path", "verdict", reversed_host(F.col("host")).alias("key"))
    prefixes = clean.select(
        "key", F.col("path").alias("own"),
        F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("path"),
    )
    entry = F.struct(
        F.length("path").alias("depth"), "path", (F.length("host") + F.length("path")).alias("size"),
        F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict",
    )
    return (
        prefixes.join(clean, ["key", "path"]).groupBy("key", "own")
        .agg(F.sort_array(F.collect_list(entry)).alias("stack"))
        .select("key", F.col("own").alias("path"), "stack")
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id",
          url: str = "url", lot: int = LOT) -> DataFrame:
    """`page_id`, `host`, `path`, `rule` (host and path of the rule, else null), `verdict` (the
    rule's, else `default`) for each row.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest wins
    (host and path together; of equal ones that with the longer host, then the later in the
    alphabet). Null and odd urls have an empty host and path, which only a rule for the empty host
    fits. Repeated rows are judged each, repeated urls only once; null ids stay null. Without rules
    all get the default; an empty table stays empty.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    stacks = rule_stacks(rules)
    labels = F.split("host", r"\.", -1)
    # every suffix of the host, reversed: one probe each
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.array_join(F.reverse(F.slice(labels, -n, n)), DOT),
    )
    probes = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("key"))
    probes = probes.join(stacks.select("key").distinct(), "key")
    lots = probes.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / lot).cast("int").alias("lots"))
    in_lots = probes.join(lots, "key").select(
        "key", F.pmod(F.xxhash64("host", "path"), F.col("lots")).cast("int").alias("lot"), "path",
        F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"),
    )
    starts = stacks.join(lots, "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "path",
        F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack",
    )
    sweep = Window.partitionBy("key", "lot").orderBy("path", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    swept = starts.unionByName(in_lots).withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
    open_rules = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    found = (
        swept.where("kind = 1").select("host", "path", F.try_element_at(open_rules, F.lit(-1)).alias("r")).where("r is not null")
        .groupBy("host", "path")
        .agg(F.max(F.struct("r.size", "r.host_size", "r.rule", "r.verdict")).alias("r"))
    )
    return rows.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.lit(default)).alias("verdict"),
    )
