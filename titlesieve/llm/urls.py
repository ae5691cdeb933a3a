"""URL filter: rules by host and path, and for the rest a verdict a host from the link graph.

Trust flows from hosts that rules allow along links (personalised PageRank); distrust flows from hosts that
rules block against the links, to those that link to them. A host whose distrust outweighs its trust is
blocked. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
_TARGET = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?(//[^/?#"'\s>]+[^#"'\s>]*)"""


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules of the query (fixed by its contract).
RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)


@dataclass(frozen=True)
class LinkTrust:
    damping: float = 0.85
    moved: float = 1e-9  # of each flow's total of 1, the mass still on its way when it is left
    joined: int = 4  # steps in one plan
    tolerance: float = 1.0  # distrust above this many times the trust blocks a host


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ordered(rules: tuple[UrlRule, ...]) -> list[UrlRule]:
    return sorted(rules, key=lambda r: (-len(r.text), r.text))


def _fits(rule: UrlRule) -> Column:
    host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
    return host & F.col("path").startswith(rule.path)


def with_rule(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """Adds host, path, ``rule`` (the longest that fits, else null) and ``ruled`` (its verdict)."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    nothing = F.lit(None).cast("string")
    return out.withColumns({
        "rule": F.coalesce(*[F.when(_fits(r), F.lit(r.text)) for r in _ordered(rules)], nothing),
        "ruled": F.coalesce(*[F.when(_fits(r), F.lit(r.verdict)) for r in _ordered(rules)], nothing),
    })


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, links): links between different hosts, counted over all pages."""
    found = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("target"))
    found = found.withColumn("target", F.translate("target", _UPPER, _LOWER)).filter("source <> '' AND source <> target")
    return found.groupBy("source", "target").agg(F.count("*").alias("links"))


def _address(url: Column) -> Column:
    """A url without scheme and fragment; no path is the path ``/``."""
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def target_seeds(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """(host, allowed, blocked): link targets on other hosts that rules allow or block and that are no row of
    ``pages``, each counted once."""
    found = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(_TARGET), 1)).alias("url"))
    found = found.filter("source <> ''").withColumn("url", F.concat(F.lit(":"), "url"))
    found = found.filter(F.col("source") != host_of(F.col("url"))).select(_address(F.col("url")).alias("address"))
    ruled = with_rule(found.select("address", F.concat(F.lit("://"), "address").alias("url")), rules).filter("ruled IS NOT NULL")
    crawled = pages.select(_address(F.col("url")).alias("address"))
    new = ruled.select("address", "host", "ruled").distinct().join(crawled, "address", "left_anti")
    counted = lambda v: F.count(F.when(F.col("ruled") == v, 1)).alias(v)
    return new.groupBy("host").agg(counted("allow").alias("allowed"), counted("block").alias("blocked"))


def propagate(seeds: DataFrame, links: DataFrame, cfg: LinkTrust) -> DataFrame:
    """(host, trust, distrust). ``seeds`` has host, allowed and blocked (pages and link targets that rules allow or block);
    ``links`` as above. Each flow starts with a total of 1 on its seeds, keeps (1 - damping) of what arrives and
    passes the rest on, until less than ``moved`` is on its way; hosts without links pass nothing on."""
    flows = []
    for kind, start, end in (("trust", "source", "target"), ("distrust", "target", "source")):
        all_ = links.groupBy(F.col(start).alias("start")).agg(F.sum("links").alias("total"))
        flow = links.select(F.col(start).alias("start"), F.col(end).alias("end"), "links").join(all_, "start")
        flows.append(flow.select(F.lit(kind).alias("kind"), "start", "end", (F.col("links") / F.col("total")).alias("part")))
    flow = cut(flows[0].unionByName(flows[1]))
    totals = seeds.agg(F.sum("allowed").alias("trust"), F.sum("blocked").alias("distrust")).first()
    share = lambda c, k: F.col(c) / F.lit(float(totals[k] or 1))
    known = seeds.select(
        "host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), share("allowed", "trust").alias("seed")),
                                  F.struct(F.lit("distrust").alias("kind"), share("blocked", "distrust").alias("seed")))).alias("s"))
    # what stays on a host at each step is its score's next part, the rest is on its way along the links
    way = cut(known.select("s.kind", "host", ((1 - cfg.damping) * F.col("s.seed")).alias("mass")).filter("mass > 0"))
    parts = [way]
    while not flow.isEmpty():
        for _ in range(cfg.joined):
            came = way.join(flow.withColumnRenamed("start", "host"), ["kind", "host"])
            came = came.groupBy("kind", F.col("end").alias("host")).agg(F.sum(F.col("mass") * F.col("part")).alias("came"))
            way = came.select("kind", "host", (cfg.damping * F.col("came")).alias("mass"))
            parts.append(way)
        way = cut(way)
        parts = [cut(_summed(parts[:-1]).unionByName(way))]
        if (way.groupBy("kind").agg(F.sum("mass").alias("left")).agg(F.max("left")).first()[0] or 0.0) <= cfg.moved:
            break
    scores = _summed(parts)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(k)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def _summed(parts: list[DataFrame]) -> DataFrame:
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, cfg: LinkTrust = LinkTrust()) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html; nothing else is read): page_id, host, path, rule,
    verdict, trust and distrust of the host.

    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed; null html has
    no links. Repeated rows count each. Hosts that neither flow reaches are allowed. An empty table gives an
    empty result.
    """
    ruled = with_rule(pages.select("page_id", "url"), rules)
    counted = lambda v: F.count(F.when(F.col("ruled") == v, 1))
    seeds = ruled.filter("host <> ''").groupBy("host").agg(counted("allow").alias("allowed"), counted("block").alias("blocked"))
    seeds = seeds.unionByName(target_seeds(pages.select("url", "html"), rules))
    seeds = cut(seeds.groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")))
    hosts = cut(propagate(seeds, cut(host_links(pages.select("url", "html"))), cfg))
    joined = ruled.join(hosts, "host", "left")
    method = F.when(F.col("distrust") > cfg.tolerance * F.col("trust"), "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op7(pages: DataFrame) -> DataFrame:
    """The contract of the query."""
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
