"""URL filter: rules, then empirical-Bayes reputation of hosts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the urls of ``host`` and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def site(h: Column) -> Column:
    """Host without user and port."""
    return F.regexp_replace(h, r"^.*@|:[0-9]*$", "")


def suffix(s: Column, two: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    last_two = F.substring_index(s, ".", -2)
    return F.when(last_two.isin(*two), last_two).otherwise(F.substring_index(s, ".", -1))


def domain(s: Column, two: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    return F.when(F.substring_index(s, ".", -2).isin(*two), F.substring_index(s, ".", -3)).otherwise(F.substring_index(s, ".", -2))


def rule_of(h: Column, p: Column, rules: Sequence[Rule]) -> Column:
    """(text, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def strength(groups: DataFrame, least: float = 1.0, most: float = 1000.0) -> tuple[float, float]:
    """(overall bad rate, prior strength) of groups with columns n and bad: beta-binomial moments.

    The spread between groups beyond what chance gives sets the intra-group correlation rho, the strength is 1/rho - 1.
    """
    t = groups.agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"),
    ).first()
    if not t.n:
        return 0.5, most
    p = t.bad / t.n
    spread, free = t.bb - t.bad * p, t.n - t.nn / t.n - (t.g - 1)
    if p in (0.0, 1.0) or free <= 0:
        return p, most
    rho = (spread / (p * (1 - p)) - (t.g - 1)) / free
    return p, min(most, max(least, 1 / rho - 1)) if rho > 0 else most


def reputation(seen: DataFrame, sites: DataFrame) -> DataFrame:
    """Posterior Beta(a, b) of the bad rate of every site in ``sites``: columns site, a, b.

    ``seen`` has n labelled pages and bad among them by site.  A suffix is shrunk to the overall rate, a domain to its
    suffix, a site to its domain, each by a strength fitted to the spread at its level; a name without labels takes the
    mean of the level above.
    """
    c = F.col
    by_site = stage(seen.withColumns({"domain": domain(c("site")), "suffix": suffix(c("site"))}))
    total = lambda *k: by_site.groupBy(*k).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_domain, by_suffix = total("domain", "suffix"), total("suffix")
    p, k_suffix = strength(by_suffix)
    (_, k_domain), (_, k_site) = strength(by_domain), strength(by_site)
    mean = lambda k, up: (c("bad") + F.lit(k) * up) / (c("n") + F.lit(k))
    s = by_suffix.select("suffix", mean(k_suffix, F.lit(p)).alias("s_mean"))
    d = by_domain.join(s, "suffix").select("domain", mean(k_domain, c("s_mean")).alias("d_mean"))
    named = sites.withColumns({"domain": domain(c("site")), "suffix": suffix(c("site"))})
    all_of = (
        named.join(by_site.select("site", "n", "bad"), "site", "left").join(d, "domain", "left").join(s, "suffix", "left")
    )
    prior = F.coalesce("d_mean", "s_mean", F.lit(p))
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    return all_of.select("site", (bad + k_site * prior).alias("a"), (n - bad + k_site * (1 - prior)).alias("b"))


def outcomes(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, bad) of labelled pages: bad if the quality is known to be 0 or the page to be toxic; a row that says neither is none."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col(id_col).alias("id"), bad.cast("int").alias("bad"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], z: float = 1.64, threshold: float = 0.5,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """Rows (id, host, path, rule, verdict) for every row of ``pages``, repeated ones included.

    ``outcomes`` has id and bad (0 or 1): labelled pages; an id's repeated outcomes count as one, bad if any is, and a
    repeated page counts once.  The longest rule that fits decides.  Without one, a page is blocked if the lower bound
    of its site's posterior bad rate (mean less ``z`` deviations) is over ``threshold``.  A null url, or one without
    ``://``, has an empty host and path and is judged as the site without a name; null ids are never labelled.  Other
    columns are ignored.  Counts are summed before any shuffle and by site after it, so a hot host is a row a task.
    """
    c = F.col
    p = pages.select(c(id_col).alias("page_id"), c(url_col).alias("url"))
    p = p.withColumns({"host": host(c("url")), "path": path(c("url"))}).withColumn("site", site(c("host")))
    said = outcomes.where(c("id").isNotNull() & c("bad").isNotNull()).groupBy(c("id").alias("page_id")).agg(
        F.max(c("bad").cast("bigint")).alias("bad"))
    labelled = p.select("page_id", "site").join(said, "page_id").groupBy("page_id", "site").agg(F.max("bad").alias("bad"))
    seen = labelled.groupBy("site").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    post = reputation(seen, p.select("site").distinct())
    a, b = c("a"), c("b")
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    blocked = stage(post.select("site", (bound > threshold).alias("blocked")))  # a plain table: a hot site's join can be split
    rule = rule_of(c("host"), c("path"), rules)
    return p.join(blocked, "site").withColumn("r", rule).select(
        "page_id", "host", "path", c("r.text").alias("rule"),
        F.coalesce(c("r.verdict"), F.when(c("blocked"), "block").otherwise("allow")).alias("verdict"),
    )
