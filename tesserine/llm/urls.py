"""URL filter: prefix rules, and beyond them trust and distrust that flow over host links.

Rules judge pages. For pages without one, hosts are judged by the link graph: trust
starts at hosts with pages that a rule allows and follows links (personalised
PageRank); distrust starts at hosts whose pages are nearly all blocked by rules and
follows links backwards, for who links to a blocked host shares its blame. A host is
blocked when its distrust exceeds its trust and a floor.

DataFrame functions only. Walks end at hosts without links, and the masses of each
step are written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``rule`` is a host, and a path from its first ``/`` on. It fits the host and its subdomains."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)
#: Share of a step's mass that follows links; the rest stays.
DAMPING = 0.85
#: Masses move until what moves is below this share of one kind's seeds, unless a number of steps is given.
LEFT = 1e-6
#: A link's target, quoted or not; what follows a blank is not needed for its host.
HREF = r"""(?i)href\s*=\s*["']?\s*([^"'>\s]*)"""
#: Share of a host's pages that rules must block for it to be a blocked seed.
SEED_SHARE = 0.9
#: Distrust below this share of a seed's mean mass never blocks.
FLOOR = 0.05


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host on up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. Ties go to the later string."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    best = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.rule)).alias("n"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    top = F.greatest(*best) if len(best) > 1 else best[0]
    return top["rule"], top["verdict"]


def links(pages: DataFrame) -> DataFrame:
    """Links between different hosts, counted: ``src``, ``dst``, ``n``. Relative links stay on their host."""
    to = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(HREF), 1)).alias("href"))
    to = to.where(F.col("href").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"))
    to = to.select("src", host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), "href")).otherwise(F.col("href"))).alias("dst"))
    return to.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int | None = None) -> DataFrame:
    """Mass of each ``kind`` and ``host`` after as many steps from seeds (``kind``, ``host``, ``mass``) as it takes until what
    still moves is below :data:`LEFT`, or after ``steps`` of them.

    Kind ``trust`` follows links, ``distrust`` follows them backwards, each link in proportion to its count. ``edges`` is a
    written table, and so is what it is joined with: Spark splits a skewed partition (a host with many links) of a join of two
    scans, but not of one that an aggregate feeds.
    """
    out = stored(edges.groupBy("src").agg(F.sum("n").alias("all")), "out")
    into = stored(edges.groupBy("dst").agg(F.sum("n").alias("all")), "into")
    ways = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("share"))
    ways = ways.unionByName(edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("share")))
    ways = stored(ways, "ways")
    now = stored(seeds, "mass")
    made = [now]
    while steps is None or len(made) <= steps:
        then = now.join(ways, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg((damping * F.sum(F.col("mass") * F.col("share"))).alias("mass"))
        now = stored(then, "mass")
        moving = now.agg(F.sum("mass")).first()[0]
        if moving is None:
            drop_stored(now)
            break
        made.append(now)
        if steps is None and moving < LEFT:
            break
    total = made[0]
    for m in made[1:]:
        total = total.unionByName(m)
    return total.groupBy("kind", "host").agg(((1 - damping) * F.sum("mass")).alias("mass"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html", damping: float = DAMPING, steps: int | None = None) -> DataFrame:
    """``pages`` without ``html``, with ``host``, ``path``, ``rule`` (or null), ``verdict`` (allow or block), and the
    host's ``trust`` and ``distrust``.

    Input columns of those names are replaced. A null url, or one without ``://``, has an empty host and path and is
    allowed. Null html has no links. Repeated rows count as pages each. Without seeds all masses are zero.
    """
    added = ["host", "path", "rule", "verdict", "trust", "distrust"]
    rest = [c for c in pages.columns if c.lower() not in {*added, html.lower()}]
    address = F.col(url).cast("string")
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), host_of(address).alias("host"), path_of(address).alias("path"), F.col(html).cast("string").alias("html"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "by_rule": verdict})
    hosts = base.where(F.col("host") != "").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")
    )
    hosts = stored(hosts, "hosts")
    bad = F.col("blocked") >= SEED_SHARE * F.col("pages")
    good = ~bad & (F.col("allowed") > 0)
    sums = hosts.agg(F.sum(F.when(good, F.col("allowed"))).alias("good"), F.sum(F.when(bad, F.col("blocked"))).alias("bad"), F.count_if(bad).alias("n")).first()
    seeds = hosts.where(good).select(F.lit("trust").alias("kind"), "host", (F.col("allowed") / F.lit(sums.good or 1)).alias("mass"))
    seeds = seeds.unionByName(hosts.where(bad).select(F.lit("distrust").alias("kind"), "host", (F.col("blocked") / F.lit(sums.bad or 1)).alias("mass")))
    mass = propagated(seeds, stored(links(base), "edges"), damping, steps)
    mass = mass.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))), F.lit(0.0)).alias("distrust")
    )
    joined = base.drop("html").join(stored(mass, "masses"), "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    floor = FLOOR * (1 - damping) / max(1, sums.n)
    by_host = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= floor), "block").otherwise("allow")
    return joined.select(*[F.col("_row")[c].alias(c) for c in rest], "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")
