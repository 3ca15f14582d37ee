"""URL verdicts by rules and link-graph propagation.

Rules judge the urls they fit.  For the rest, hosts are judged: trust starts at
hosts with pages that a rule allows and follows links, distrust starts at hosts
with blocked pages and follows links backwards (who links to a blocked host), both
as personalised PageRank over host edges in Spark.  Host edges are the links of
the pages to other hosts and the step from a host to its parent domain.  A host is blocked when its distrust exceeds its trust by a threshold,
both as multiples of what a host of its size starts with if rules judge all its pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclens.llm.common import written

DAMPING, THRESHOLD = 0.85, 0.5
ROUNDS, TOLERANCE = 8, 1e-6  # rounds between two looks at the rest; what a judged value may lack at the end
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, ruled``: the longest rule that fits decides."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, ruled = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(ruled)
    return (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
        .select("page_id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
        .select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    )


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, weight``: links between different hosts, summed per pair, and the
    steps from a host to its parent domain (of two labels or more)."""
    source = host_of(F.col(url_col))
    links = (
        pages.select(source.alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("dst"))
        .withColumn("dst", F.translate("dst", _UPPER, _LOWER))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    hosts = pages.select(source.alias("host")).distinct()
    labels = F.split("host", r"\.")
    # every parent of every host: one row for each label that can go
    steps = hosts.where(F.size(labels) > 2).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.size(labels) - 3), lambda i: F.struct(
            F.concat_ws(".", F.slice(labels, i + 1, F.size(labels) - i)).alias("src"),
            F.concat_ws(".", F.slice(labels, i + 2, F.size(labels) - i - 1)).alias("dst"),
        ))).alias("s")
    ).select("s.src", "s.dst").distinct().withColumn("weight", F.lit(1.0))
    return links.unionByName(steps).where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(
        F.sum("weight").alias("weight")
    )


def propagate(edges: DataFrame, hosts: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust``: personalised PageRank along the edges from the
    hosts' ``allowed`` pages, and against the edges from their ``blocked`` pages.
    A host without edges to follow passes nothing on.

    The ranks are the sums of what arrives after 0, 1, 2, ... links.  All that is
    still to come is at most the last round's sum times damping / (1 - damping), and
    rounds go on until that changes no host's judged value by ``TOLERANCE``."""
    total = hosts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    allowed, blocked = float(total["a"] or 0), float(total["b"] or 0)
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("into"))
    flows = written(
        edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("weight") / F.col("out")).alias("along"), (F.col("weight") / F.col("into")).alias("back")),
        "host-flows",
    )
    nodes = hosts.select("host", "allowed", "blocked").unionByName(
        flows.select(F.col("src").alias("host"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked"))
    )
    seeds = written(
        nodes.groupBy("host").agg(
            (F.sum("allowed") / F.lit(allowed or 1.0)).alias("trust"), (F.sum("blocked") / F.lit(blocked or 1.0)).alias("distrust")
        ),
        "host-seeds",
    )
    zero, moved = F.lit(0.0), ("new_trust", "new_distrust")
    start = [(F.col(c) * F.lit(1 - damping)) for c in ("trust", "distrust")]
    ranks = seeds.select("host", *[x.alias(c) for x, c in zip(start, ("trust", "distrust"))], *[x.alias(c) for x, c in zip(start, moved)])
    scale = damping / (1 - damping) ** 2  # of a round's sum: all that is to come, in judged values of a host of one page
    while True:
        for _ in range(rounds):
            along = flows.join(ranks, flows["src"] == ranks["host"]).select(
                F.col("dst").alias("host"), zero.alias("trust"), zero.alias("distrust"),
                (F.col("new_trust") * F.col("along") * F.lit(damping)).alias("new_trust"), zero.alias("new_distrust"),
            )
            back = flows.join(ranks, flows["dst"] == ranks["host"]).select(
                F.col("src").alias("host"), zero.alias("trust"), zero.alias("distrust"),
                zero.alias("new_trust"), (F.col("new_distrust") * F.col("back") * F.lit(damping)).alias("new_distrust"),
            )
            kept = ranks.select("host", "trust", "distrust", *[zero.alias(c) for c in moved])
            sums = along.unionByName(back).unionByName(kept).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", *moved)])
            ranks = written(
                sums.select("host", (F.col("trust") + F.col("new_trust")).alias("trust"), (F.col("distrust") + F.col("new_distrust")).alias("distrust"), *moved),
                "host-ranks",
            )
        last = ranks.agg(*[F.sum(c).alias(c) for c in moved]).first()
        rest = max(allowed * (last["new_trust"] or 0.0), blocked * (last["new_distrust"] or 0.0)) * scale
        if rest < TOLERANCE:
            break
    return ranks.select("host", "trust", "distrust")


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD
) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per input row.

    A url that is NULL or without ``://`` has an empty host and path, meets no rule
    and is allowed; NULL html has no links."""
    verdicts = judged(pages, rules, id_col, url_col)
    hosts = written(
        verdicts.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"),
            F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
        ),
        "hosts",
    )
    total = hosts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    ranks = propagate(host_edges(pages, url_col, html_col), hosts)
    per_page = lambda rank, n: F.col(rank) * F.lit(float(n or 0) / (1 - DAMPING)) / F.col("pages")
    bad = (
        hosts.join(ranks, "host")
        .where(per_page("distrust", total["b"]) - per_page("trust", total["a"]) >= F.lit(threshold))
        .select("host", F.lit("block").alias("by_links"))
    )
    return verdicts.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_links", F.lit("allow")).alias("verdict"))
