"""URL filters: rules first, else empirical-Bayes host reputation.

Pages that a rule judges are the labelled outcomes (1 where it blocks). Each host's rate is shrunk towards its registered domain's,
that towards its suffix's and that towards the rate of all, each through a beta-binomial prior: the mean comes from the level
above, the strength from the spread among the groups of the level itself, by moments. An unjudged page is
blocked if the lower posterior bound (mean less ``Z`` deviations) of its host's rate is over ``BAD``.

Host and path: after the first ``://``; see ``parts``. A port aside, the suffix is the last label, or the last two where they are in ``SUFFIXES`` (a parameter), and the registered domain has one label more.
An address is a domain of its own, under the suffix ``address``. A null url, or one without ``://``, has an empty host and path and is judged like any host. A null page_id is kept
as null, repeated rows stay repeated, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
Z, BAD, LEAST, MOST = 1.645, 0.5, 1.0, 1000.0
# Common suffixes of two labels under which anyone registers.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "org.uk", "com.au", "edu.au", "net.au", "org.au", "ac.jp", "co.jp", "ne.jp", "or.jp", "co.nz", "org.nz", "co.za", "org.za", "com.br", "org.br", "com.ar", "com.mx", "com.cn", "net.cn", "org.cn", "com.hk", "com.tw", "com.sg", "co.in", "co.kr", "co.il", "com.tr")
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = url.isNull() | (at == 0)
    return F.when(none, "").otherwise(host), F.when(none, "").otherwise(path)


def ruled(rules) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits host and path; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def owner(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    back = F.reverse(F.split(bare, r"\."))
    two = F.concat_ws(".", F.get(back, 1), F.get(back, 0))
    address, known = bare.rlike(ADDRESS), two.isin(list(suffixes))
    return F.when(address, bare).when(known, F.concat_ws(".", F.get(back, 2), two)).otherwise(two), F.when(address, "address").when(known, two).otherwise(F.get(back, 0))


def strength(groups: DataFrame) -> float:
    """Prior strength from groups (n, k) with n > 0: (1 - r) / r, r the correlation of outcomes in a group, by moments."""
    s = groups.where("n > 0").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.expr("cast(n as double) * n")).alias("nn"), F.sum(F.expr("cast(k as double) * k / n")).alias("kk")).first()
    if not s["n"] or s["g"] < 2:
        return MOST
    m = s["k"] / s["n"]
    within, spread = m * (1 - m), s["kk"] - s["n"] * m * m
    span = s["n"] - s["nn"] / s["n"] - (s["g"] - 1)
    if within <= 0 or span <= 0:
        return MOST
    r = (spread - within * (s["g"] - 1)) / (within * span)
    return MOST if r <= 1 / (1 + MOST) else LEAST if r >= 1 / (1 + LEAST) else (1 - r) / r


def judge(pages: DataFrame, rules=RULES, suffixes=SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url)."""
    host, path = parts(F.col("url"))
    rule, own = ruled(rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), own.alias("own"))
    domain, suffix = owner(F.col("host"), suffixes)
    hosts = cut(
        rows.groupBy("host").agg(F.count("rule").alias("n"), F.count(F.when(F.col("own") == "block", 1)).alias("k"))
        .select("*", domain.alias("domain"), suffix.alias("suffix"))
    )
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = cut(total(hosts, "domain", "suffix"))
    suffixes = cut(total(domains, "suffix"))
    n, k = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    rate = (k + 0.5) / (n + 1.0)
    by_host, by_domain, by_suffix = (strength(x) for x in (hosts, domains, suffixes))
    shrunk = lambda mean, s: (F.col("k") + mean * s) / (F.col("n") + s)
    suffixes = suffixes.select("suffix", shrunk(F.lit(rate), by_suffix).alias("above"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", shrunk(F.col("above"), by_domain).alias("above"))
    a, b = F.col("k") + F.col("above") * by_host, F.col("n") - F.col("k") + (1 - F.col("above")) * by_host
    bound = a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    judged = cut(hosts.join(domains, ["domain", "suffix"]).select("host", F.when(bound > BAD, "block").otherwise("allow").alias("by_host")))
    return rows.join(judged, "host").select("page_id", "host", "path", "rule", F.coalesce("own", "by_host").alias("verdict"))
