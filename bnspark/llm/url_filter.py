"""URL verdicts: explicit rules first, then trust and distrust propagated over the links between hosts.

Hosts whose pages are mostly blocked by rules are blocked seeds; other hosts with a page that a rule
allows are trusted seeds.  Personalised PageRank runs from the trusted seeds along the links, and from the
blocked seeds against them: a host is good if good hosts link to it, and bad if it links to bad ones.
The mass of hosts without links goes back to the seeds.  With that, a score is the sum over all lengths of
damped paths from the seeds, scaled to a sum of one; lengths are added until what a longer one can still
add to any host is less than TOLERANCE.  Both scores are in units of a seed's share; a
host whose distrust exceeds its trust by more than THRESHOLD has its remaining pages blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bnspark.llm.common import attach, drop, materialize

DAMPING = 0.85
MOSTLY = 0.5
# Half of what a seed that nothing links to keeps as its own: seeds pass it, hosts that they reach may.
THRESHOLD = 0.5 * (1 - DAMPING)
TOLERANCE = 0.01 * THRESHOLD  # of a seed's share
MOST_ROUNDS, ROUNDS_A_TABLE = 400, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
Rule = tuple[str, str, str]  # host, path, allow or block


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for a null url or one without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str, verdict: str) -> Rule:
    """('example.com/en/', 'block') as host and path; the path starts with the first slash."""
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path, verdict


def host_rules(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per host, the rules that fit it, longest first: (host, rules array<struct<path, rule, verdict>>).
    The table of rules is joined on each suffix of a host, so it may be long."""
    spark = hosts.sparkSession
    given = spark.createDataFrame(list(rules), "of string, path string, verdict string")
    given = given.groupBy("of", "path").agg(F.max("verdict").alias("verdict"))  # of both, block wins
    names = F.split("host", r"\.")
    n = F.size(names)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(names, i, n), "."))
    wide = hosts.select("host", F.explode(suffixes).alias("of")).join(given, "of")
    one = F.struct((-F.length(F.concat("of", "path"))).alias("short"), F.concat("of", "path").alias("rule"), "path", "verdict")
    return wide.groupBy("host").agg(F.array_sort(F.collect_list(one)).alias("rules"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts in the pages' html."""
    host, _ = host_and_path(F.col("url"))
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)
    out = pages.select(host.alias("src"), F.explode(found).alias("dst"))
    out = out.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> '' and src <> dst")
    return out.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: links (kind, src, dst, n), seeds (kind, host, share) whose shares sum to 1
    for each kind; gives (kind, host, score).  Every ROUNDS_A_TABLE rounds are written and read back, so a lost
    executor costs those.  What rounds add shrinks by DAMPING at least, so the largest addition to a host, times
    DAMPING / (1 - DAMPING), bounds all that are to come."""
    out_of = links.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = materialize(
        links.join(out_of, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total") * DAMPING).alias("w")),
        "edges",
    )
    new = materialize(seeds.select("kind", "host", F.col("share").alias("score")), "seeds")
    if edges.isEmpty():  # then all mass goes back to the seeds in each round
        return new
    # In units of a seed's share; the scale to a sum of one is at most 1.
    unit = {r["kind"]: r["n"] for r in new.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    large = F.lit(0.0)
    for kind, n in unit.items():
        large = F.when(F.col("kind") == kind, F.col("score") * n).otherwise(large)
    total = new
    for _ in range(MOST_ROUNDS // ROUNDS_A_TABLE):
        added = []
        for _ in range(ROUNDS_A_TABLE):
            new = edges.join(new, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("w") * F.col("score")).alias("score"))
            added.append(new.withColumn("round", F.lit(len(added))))
        every = added[0]
        for more in added[1:]:
            every = every.unionByName(more)
        every = materialize(every, "added")
        whole = total.unionByName(every.drop("round")).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        whole = materialize(whole, "ranks")
        drop(total)
        total, new = whole, every.where(F.col("round") == ROUNDS_A_TABLE - 1).drop("round")
        most = new.agg(F.max(large)).first()[0] or 0.0
        if most * DAMPING / (1 - DAMPING) < tolerance:
            break
    else:
        raise RuntimeError(f"scores still change by {most} of a seed's share after {MOST_ROUNDS} rounds")
    drop(edges)
    sums = F.broadcast(total.groupBy("kind").agg(F.sum("score").alias("sum")))  # a row for each of two kinds
    return total.join(sums, "kind").select("kind", "host", (F.col("score") / F.col("sum")).alias("score"))


def verdicts(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row for each row of pages, repeats included: page_id, host, path, rule, verdict.

    A rule fits its host and all its subdomains if the path starts with the rule's; the longest wins,
    and of a rule given both ways the block.  Pages without a rule get their host's verdict by
    propagation.  A null url or one without :// has an empty host, which no rule fits, which is
    never a seed and is allowed.  Null html has no links.  An empty table gives no rows; a null
    page_id stays null."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages"))
    sizes = materialize(sizes, "hosts")
    total = sizes.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    fitting = sizes.join(host_rules(sizes.where("host <> ''").select("host"), rules), "host", "left").select("host", "pages", "rules")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    ruled = attach(rows, materialize(fitting, "rules"), "host", "pages", total)
    ruled = ruled.withColumn("hit", F.get(fits, F.lit(0)))
    ruled = materialize(ruled.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("said")), "ruled")
    marks = ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("said") == "block").alias("bad"), F.count_if(F.col("said") == "allow").alias("good")
    )
    kind = F.when(F.col("bad") >= MOSTLY * F.col("pages"), "distrust").when(F.col("good") > 0, "trust")
    seeds = materialize(marks.select(kind.alias("kind"), "host").where("kind is not null"), "seeds")
    many = dict(seeds.groupBy("kind").count().collect())
    share = F.when(F.col("kind") == "trust", 1.0 / many.get("trust", 1)).otherwise(1.0 / many.get("distrust", 1))
    links = materialize(host_links(pages.select("url", "html")), "links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    both = both.where(F.col("kind").isin(list(many)))
    ranks = propagate(both, seeds.withColumn("share", share))
    unit = F.when(F.col("kind") == "trust", -F.lit(float(many.get("trust", 1)))).otherwise(F.lit(float(many.get("distrust", 1))))
    excess = ranks.groupBy("host").agg(F.sum(F.col("score") * unit).alias("excess"))
    bad = sizes.join(excess.where(F.col("excess") > THRESHOLD).select("host"), "host", "left_semi")
    bad = materialize(bad.select("host", "pages", F.lit("block").alias("judged")), "bad")
    for old in (links, seeds):
        drop(old)
    out = attach(ruled, bad, "host", "pages", total)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "judged", F.lit("allow")).alias("verdict"))
