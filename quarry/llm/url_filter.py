"""URL filter: rules first, then trust and distrust spread over host edges.

A rule is (host, path, verdict). It fits its host and all subdomains when the
url's path starts with the rule's path; of several the longest wins (host and
path together). Hosts without a fitting rule are judged by propagation:

* trust: personalised PageRank along links, started from hosts in proportion
  to how much of them the rules allow;
* distrust: the same against the links, started from what the rules block (who
  links to bad hosts is suspect).

Edges come from absolute links in the pages, counted per pair of hosts, and
from the naming of hosts (a host and its parent domain speak for each other;
the parent must have at least two labels). Mass that reaches a host without
edges ends there.

Trust and distrust are shares of a whole and have no scale of their own. Two
more walks against the links give distrust one: from every host with a blocked
page, and from every host, each with mass 1. A url without a rule is blocked if
all of this holds for its host, and allowed else:

* its share of distrust in trust and distrust exceeds ``threshold``;
* the hosts its distrust comes from, itself among them, are blocked by
  ``PART_BLOCKED`` or more of their pages on (weighted) average, so a few
  blocked pages do not condemn the rest of a host;
* these hosts are at least ``PART_NEAR`` of all hosts that reach it, so a parent
  that many hosts share does not carry one's distrust to all the others.

Each page is reduced to its host before anything is shuffled, links are
counted per task first, so a host with a third of all pages is a few rows.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule and is allowed; null html has no links; repeated rows are judged
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

# rules of the contract: host, path, verdict
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.8
ROUNDS = 12
KEEP_EVERY = 4          # rounds between stored stages
THRESHOLD = 0.5
NAMING_WEIGHT = 0.5     # of a naming edge, in links
PART_BLOCKED, PART_NEAR = 0.5, 0.1


def host_of(url):
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host, path, rules=RULES):
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts."""
    link = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?(//[^/?#"'\s>]+)"""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(link), F.lit(1))
    linked = (pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(found)).alias("to"))
                   .select("src", F.translate(F.regexp_replace("to", "^//", ""), UPPER, LOWER).alias("dst"))
                   .where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    labels = F.split("host", r"\.")
    # every suffix of at least two labels: a.b.c.d has b.c.d and c.d
    steps = F.sequence(F.lit(1), F.size(labels) - 1)
    chain = F.transform(steps, lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("child"),
                                                 F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("parent")))
    everyone = hosts.select("host").unionByName(linked.select(F.col("dst").alias("host"))).distinct()
    naming = (everyone.where(F.size(labels) > 2).select(F.explode(chain).alias("e")).select("e.child", "e.parent")
                      .where(F.size(F.split("parent", r"\.")) >= 2).distinct())
    weight = F.lit(NAMING_WEIGHT).alias("weight")
    both = (naming.select(F.col("child").alias("src"), F.col("parent").alias("dst"), weight)
                  .unionByName(naming.select(F.col("parent").alias("src"), F.col("child").alias("dst"), weight)))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, mass): all walks at once; kind tells them apart."""
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    edges = stored(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "url-edges")
    start = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    mass = seeds.select("kind", "host", "mass")
    for i in range(1, rounds + 1):
        moved = (edges.join(mass.select("kind", F.col("host").alias("src"), "mass"), ["kind", "src"])
                      .select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass")))
        mass = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if i % KEEP_EVERY == 0 or i == rounds:
            mass = stored(mass, "url-mass")
    return mass


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    prepare(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fits", matching_rule(F.col("host"), F.col("path"), rules))
    cut = cut.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.col("fits.verdict").alias("by_rule"))
    seen = stored(cut.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"),
                                                           F.count_if(F.col("by_rule") == "block").alias("blocked")), "url-hosts")
    links = host_edges(pages, seen)
    against = F.explode(F.array(*map(F.lit, ("distrust", "source", "any")))).alias("kind")
    edges = (links.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
                  .unionByName(links.select(against, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    start = F.create_map(F.lit("trust"), F.col("allowed") / F.col("n"), F.lit("distrust"), F.col("blocked") / F.col("n"),
                         F.lit("source"), (F.col("blocked") > 0).cast("double"), F.lit("any"), F.lit(1.0))
    seeds = stored(seen.select("host", F.explode(start).alias("kind", "mass")).where("mass > 0"), "url-seeds")
    mass = propagate(stored(edges, "url-links"), seeds)
    total = {r.kind: r.total for r in seeds.groupBy("kind").agg(F.sum("mass").alias("total")).collect()}      # four rows
    value = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)) / total.get(kind, 1.0)
    raw = lambda kind: value(kind) * total.get(kind, 1.0)
    # the slack is for sums in another order
    scaled = ((raw("distrust") >= (PART_BLOCKED - 1e-9) * raw("source")) & (raw("source") >= (PART_NEAR - 1e-9) * raw("any"))).alias("weighty")
    hosts = mass.groupBy("host").agg(value("trust").alias("trust"), value("distrust").alias("distrust"), scaled).where("trust + distrust > 0")
    judged = cut.join(hosts, "host", "left")
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    method = F.when((share > threshold) & F.col("weighty"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "trust", "distrust")
