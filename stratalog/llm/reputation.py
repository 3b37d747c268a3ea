"""URL filters: rules on host and path, then empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host, registered domain and suffix.  Each
level's rate is shrunk towards its parent's by a beta-binomial prior whose strength
comes from how much rates differ at that level; a host is blocked where the lower
posterior bound of its bad rate is above a limit, by default the mean rate of all
outcomes: the host is worse than the average page, and surely so.  A host without labelled pages is
judged by the posterior of its registered domain, else of its suffix, else of all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: verdict, host, path
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Suffixes of two labels under which unrelated owners register names; further ones are a parameter away.  Fixed values of
#: the public suffix list, the most common ones.
SUFFIXES = (
    "ac.uk", "blogspot.com", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx",
    "com.sg", "com.tr", "com.tw", "edu.au", "edu.cn", "github.io", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk", "wordpress.com",
)
#: The suffix of all addresses, which are their own domains.
ADDRESS = "[address]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where it is null or has no ://."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_for(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; null where none fits."""
    name: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # a longer rule wraps a shorter one
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port.

    The suffix is the last label, or the last two where suffixes has them, and the domain is one label more.
    IP addresses are domains of their own and share the suffix ADDRESS.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address = bare.rlike(r"^([0-9]+[.]){3}[0-9]+$") | bare.startswith("[")
    two = F.substring_index(bare, ".", -2).isin(*suffixes) if suffixes else F.lit(False)
    last = lambda n: F.substring_index(bare, ".", -n)
    return F.when(address, bare).when(two, last(3)).otherwise(last(2)), F.when(address, F.lit(ADDRESS)).when(two, last(2)).otherwise(last(1))


def _strength(counts: DataFrame) -> Column:
    """Prior strength (pseudo-counts, 1 to 10000) from the spread of rates of counts(n, bad), by moments."""
    n, bad, k = F.sum("n"), F.sum("bad"), F.count("*")
    m = bad / n
    spread = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - bad * bad / n
    noise = (k - 1) * m * (1 - m)
    room = m * (1 - m) * (n - F.sum(F.col("n") * F.col("n")) / n - (k - 1))
    rho = F.when((k > 1) & (m > 0) & (m < 1) & (room > 0), (spread - noise) / room)
    return F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(1.0)), F.lit(10000.0))).otherwise(F.lit(10000.0))


def reputation(outcomes: DataFrame, z: float = 1.645, hosts: DataFrame | None = None) -> DataFrame:
    """One row per host of outcomes(host, bad 0/1) and of hosts(host): host, n, bad (long), rate, bound and mean (double).

    rate is the posterior mean of the bad rate, bound its lower credible bound (normal
    approximation with z deviations).  Hosts without outcomes have n = 0 and the rate
    and bound of what is known above them; an empty host has none above, and without
    any outcome both are null.  mean is the rate of all outcomes, the same in every row.  Counting is partial on the map side, so hot hosts cost
    nothing extra; the rest works on one row per host.
    """
    domain, suffix = levels(F.col("host"))
    counted = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))
    counted = cut(counted.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    totals = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = totals(counted, "domain", "suffix")
    suffixes = totals(domains, "suffix")
    top = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("m0"), _strength(suffixes).alias("k0"))
    k1, k2 = domains.agg(_strength(domains).alias("k1")), counted.agg(_strength(counted).alias("k2"))
    one = top.crossJoin(k1).crossJoin(k2)  # one row each

    def shrunk(df: DataFrame, parent: str, k: str, out: str) -> DataFrame:
        return df.withColumn(out, (F.col("bad") + F.col(k) * F.col(parent)) / (F.col("n") + F.col(k)))

    s = shrunk(suffixes.crossJoin(F.broadcast(one)), "m0", "k0", "ms").select("suffix", "ms", "k1", "k2")
    d = shrunk(domains.join(s, "suffix"), "ms", "k1", "md").select("domain", "suffix", "md", "k2")
    h = shrunk(counted.join(d, ["domain", "suffix"]), "md", "k2", "rate")
    known = h.select("host", "n", "bad", "rate", (F.col("n") + F.col("k2")).alias("size"))
    if hosts is not None:
        rest = hosts.select("host").where("host <> ''").distinct().join(counted.select("host"), "host", "left_anti")
        rest = rest.withColumns({"domain": domain, "suffix": suffix}).join(d.drop("k2"), ["domain", "suffix"], "left")
        rest = rest.join(s.select("suffix", "ms"), "suffix", "left").crossJoin(F.broadcast(one))
        by = lambda md, ms, m0: F.when(F.col("md").isNotNull(), F.col(md)).when(F.col("ms").isNotNull(), F.col(ms)).otherwise(F.col(m0))
        none = F.lit(0).cast("long")
        known = known.unionByName(rest.select("host", none.alias("n"), none.alias("bad"), by("md", "ms", "m0").alias("rate"), by("k2", "k1", "k0").alias("size")))
    known = known.crossJoin(F.broadcast(one.select(F.col("m0").alias("mean"))))
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("size") + 1))
    return known.select("host", "n", "bad", "rate", F.when(bound.isNotNull(), F.greatest(bound, F.lit(0.0))).alias("bound"), "mean")


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host and bad (1: toxic or of low quality) of pages that labels (doc_id = page_id) covers."""
    host, _ = host_and_path(F.col("url"))
    bad = F.greatest(F.coalesce(F.col("toxic"), F.lit(0)), 1 - F.coalesce(F.col("quality"), F.lit(1)))
    marked = labels.where(F.col("toxic").isNotNull() | F.col("quality").isNotNull()).select(F.col("doc_id").alias("page_id"), bad.cast("long").alias("bad"))
    return pages.select("page_id", host.alias("host")).join(marked, "page_id").select("host", "bad")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, limit: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bound of every page.

    The verdict is the longest fitting rule's; else block where the host's lower bound
    is above limit (None: above the mean rate of all outcomes), and allow otherwise - also
    for urls without a host, and where no page at all is labelled.  Repeated pages each
    get a row; other columns are dropped.
    """
    host, path = host_and_path(F.col("url"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reputation(outcomes(pages, labels), hosts=rows).select("host", "bound", "mean")
    most = F.col("mean") if limit is None else F.lit(limit)
    method = F.when(F.col("bound") > most, F.lit("block")).otherwise(F.lit("allow"))
    joined = rows.join(known, "host", "left")
    return joined.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bound")
