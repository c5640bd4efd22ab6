"""URL filter: written rules first, then trust and distrust carried along the host graph.

Built-in DataFrame functions only. A page's own rule decides; all other pages get the verdict of
their host, found by two walks over the graph of hosts that link to each other:

* trust is a personalised PageRank that starts at hosts with pages the rules allow and follows the links,
* distrust starts at hosts with pages the rules block and follows the links backwards: it is the part of a host's links
  that leads to blocked pages, each further step damped. A host that links to blocked hosts alone has nearly all of
  theirs, however many others do the same; one bad link among many gives little.

Seeds weigh the share of their pages that a rule allows or blocks. Links inside a host carry nothing and count nowhere. The
walks end when no score changes by ``tolerance`` any more, which damping guarantees. A host is blocked when its
distrust exceeds ``threshold`` and also exceeds its trust by more than ``MARGIN``.

Hosts with very many links have their links cut into pieces, and their scores repeated per piece, so a hub is no single task.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and the
verdict ``allow``. Links without a host point to the page's own host; null html has no links. Repeated
rows are judged one by one, and each counts as a page. Of two fitting rules of one length the one
given first wins. Other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from recordlens.operators.joins import spread_join
from recordlens.session import discard, materialize, scratch_path

ALLOW, BLOCK = "allow", "block"
MARGIN = 1e-3  # smaller differences of trust and distrust count as none
LINKS_A_PIECE = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
LINK_HOST = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule ``(verdict, 'host/path')`` that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: (src, dst, n)."""
    targets = F.transform(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)),
        lambda link: F.translate(F.regexp_extract(link, LINK_HOST, 1), UPPER, LOWER),
    )
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return links.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_seeds(judged: DataFrame) -> DataFrame:
    """Per host: the share of its pages that a rule allows (trust_seed) and blocks (distrust_seed)."""
    def part(verdict: str) -> Column:
        return F.avg(F.when(F.col("found.verdict") == verdict, 1.0).otherwise(0.0))

    return judged.where("host <> ''").groupBy("host").agg(
        part(ALLOW).alias("trust_seed"), part(BLOCK).alias("distrust_seed")
    )


def _ways(links: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both directions of every link, and in how many pieces the ways of hosts with many are cut.

    A way (at, to, trusts, distrusts, piece) hands its part of the scores of ``at`` to ``to``.
    """
    totals = materialize(links.groupBy("src").agg(F.sum("n").alias("n_out")), "totals", folder)
    shared = spread_join(links, totals, ["src"]).withColumn("share", F.col("n") / F.col("n_out"))

    def way(at: str, to: str, trusts: Column, distrusts: Column) -> Column:
        return F.struct(F.col(at).alias("at"), F.col(to).alias("to"), trusts.alias("trusts"), distrusts.alias("distrusts"))

    none = F.lit(0.0)
    both = F.array(way("src", "dst", F.col("share"), none), way("dst", "src", none, F.col("share")))
    ways = materialize(shared.select(F.inline(both)), "both", folder)
    pieces = ways.groupBy("at").agg(F.ceil(F.count("*") / LINKS_A_PIECE).cast("int").alias("pieces"))
    many = materialize(pieces.where("pieces > 1"), "many", folder)
    count = F.coalesce("pieces", F.lit(1))
    cut = spread_join(ways, many, ["at"], "left").withColumn("piece", F.pmod(F.xxhash64("to"), count).cast("int"))
    return materialize(cut.drop("pieces"), "ways", folder), many


def host_scores(
    seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, cut_every: int = 4
) -> DataFrame:
    """Trust and distrust per host. Lineage is cut by a written table every few steps, where the change is measured."""
    spark = seeds.sparkSession
    folder = scratch_path(spark, "hosts")
    links = materialize(links, "links", folder)
    ways, many = _ways(links, folder)
    linked = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    every = seeds.join(linked, "host", "full").na.fill(0.0, ["trust_seed", "distrust_seed"])
    every = every.join(many.withColumnRenamed("at", "host"), "host", "left").na.fill(1, ["pieces"])
    seeds = materialize(every, "seeds", folder)
    start = seeds.select("host", "pieces", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    step, before = 0, start
    while True:
        score = before
        for _ in range(cut_every):
            score = _step(seeds, ways, score, damping)
        step += cut_every
        score = materialize(score, f"score{step}", folder)
        was = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        moved = F.greatest(F.abs(F.col("trust") - F.col("t")), F.abs(F.col("distrust") - F.col("d")))
        change = score.join(was, "host").agg(F.max(moved)).first()[0]
        if change is None or change < tolerance:
            return score
        if step > cut_every:
            discard(spark, f"{folder}/score{step - cut_every}")
        before = score


def _step(seeds: DataFrame, ways: DataFrame, score: DataFrame, damping: float) -> DataFrame:
    pieces = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    sent = ways.join(score.select(F.col("host").alias("at"), "trust", "distrust", pieces.alias("piece")), ["at", "piece"])
    came = sent.groupBy(F.col("to").alias("host")).agg(
        F.sum(F.col("trust") * F.col("trusts")).alias("t"), F.sum(F.col("distrust") * F.col("distrusts")).alias("d")
    )
    trust = F.col("trust_seed") + damping * F.coalesce("t", F.lit(0.0))
    distrust = F.col("distrust_seed") + (1 - F.col("distrust_seed")) * damping * F.coalesce("d", F.lit(0.0))
    return seeds.join(came, "host", "left").select("host", "pieces", trust.alias("trust"), distrust.alias("distrust"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    threshold: float = 0.5,
    damping: float = 0.85,
    tolerance: float = 1e-6,
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html)."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = parsed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    scores = host_scores(host_seeds(judged), host_links(parsed), damping, tolerance)
    bad = (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust") + MARGIN)
    suspect = scores.where(bad).select("host", F.lit(BLOCK).alias("host_verdict"))
    return spread_join(judged.drop("html"), suspect, ["host"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "host_verdict", F.lit(ALLOW)).alias("verdict"),
    )
