"""9. URL filters: listed rules, and host reputation by empirical Bayes.

Labelled pages are counted per host. A host's share of bad pages is shrunk towards
that of its registered domain, which is shrunk towards its suffix's, and that
towards the share over all labelled pages: at each level the parent's share stands
for ``strength`` pages (a beta-binomial prior). ``strength`` is fitted per level
from the spread of the children's shares beyond what chance gives (method of
moments). A host is blocked when the lower bound of its posterior share of bad
pages, Z standard deviations below the mean, is over LIMIT; hosts without
labelled pages take the mean and spread of the prior.

A host's registered domain is the label before its public suffix, the longest of
SUFFIXES that it ends with or else its last label. Its port and user name don't
count there, and an address is its own domain and suffix. Counts are summed per host
before any join and stored; hosts that many pages have are joined by broadcast. The
rules and SUFFIXES are short lists and parameters, tested as expressions.

Cases: null urls and urls without ``://`` have an empty host and path, match no rule
and are judged as the empty host; ties between rules go to the longer host, then
to block; tables without labelled pages allow what no rule blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import join_by_frequency
from .common import stored

#: (verdict, rule) with the rule's host and path.
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)
LIMIT, Z = 0.25, 1.64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    def order(rule):
        verdict, text = rule
        return -len(text), -text.index("/"), verdict != "block", text

    name = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=order, reverse=True):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


#: Public suffixes of more than one label. A deployment passes the whole public list.
SUFFIXES = (
    "ac.at", "co.at", "or.at", "com.ar", "asn.au", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "com.bd", "com.br", "gov.br", "net.br",
    "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.co", "com.eg", "com.es", "nom.es", "org.es", "asso.fr", "com.fr", "gouv.fr",
    "com.gr", "com.hk", "edu.hk", "org.hk", "co.hu", "ac.id", "co.id", "go.id", "or.id", "ac.il", "co.il", "org.il", "ac.in", "co.in", "gov.in", "net.in", "org.in",
    "co.it", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "co.ke", "ac.kr", "co.kr", "go.kr", "or.kr", "com.mx", "gob.mx", "org.mx", "com.my",
    "com.ng", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "com.pe", "com.ph", "com.pk", "com.pl", "edu.pl", "net.pl", "org.pl", "com.pt",
    "com.ru", "com.sa", "com.sg", "edu.sg", "com.tr", "edu.tr", "gov.tr", "org.tr", "com.tw", "edu.tw", "org.tw", "com.ua", "ac.uk", "co.uk", "gov.uk", "ltd.uk",
    "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk", "com.uy", "com.ve", "com.vn", "ac.za", "co.za", "org.za",
    "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com",
)
ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$"


def bare_host(host: Column) -> Column:
    """Without user name, port and a dot at the end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(?::\d*)?$|\.(?::\d*)?$", "")


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest public suffix; of one label when none is listed, of an address all of it."""
    name = bare_host(host)
    found = F.substring_index(name, ".", -1)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        end = F.substring_index(name, ".", -labels)
        found = F.when(end.isin([s for s in suffixes if s.count(".") + 1 == labels]), end).otherwise(found)
    return F.when(name.rlike(ADDRESS), name).otherwise(found)


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it."""
    name, suffix = bare_host(host), suffix_of(host, suffixes)
    before = F.substring(name, F.lit(1), F.char_length(name) - F.char_length(suffix) - 1)
    own = F.concat(F.substring_index(before, ".", -1), F.lit("."), suffix)
    return F.when(F.char_length(name) > F.char_length(suffix), own).otherwise(name)


def _strength(children: DataFrame, share: float) -> float:
    """Pages that a prior counts for: large when children differ no more than by chance."""
    s = children.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.lit(share), 2)).alias("spread"),
    ).first()
    if not s.n or s.k < 2 or s.n == s.nn / s.n or share in (0.0, 1.0):
        return 100.0
    chance = share * (1 - share)
    # Expected spread: chance * (k + rho * (n - k)), rho the correlation within a child.
    rho = (round(s.spread, 9) / chance - s.k) / max(s.n - s.k, 1)
    return round(min(max(1 / rho - 1, 1.0), 1000.0), 6) if rho > 0 else 1000.0


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, mean and sd of the share of bad pages; for every host of ``pages``.

    ``outcomes`` has (page_id, bad); one row per labelled page is expected.
    """
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"))
    labelled = hosts.join(outcomes.select("page_id", F.col("bad").cast("long").alias("bad")), "page_id", "left")
    counts = labelled.groupBy("host").agg(
        F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    h = stored(counts, "hosts").withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    d = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = s.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    share = (total.bad or 0) / total.n if total.n else 0.0
    ks, kd, kh = (_strength(x.filter("n > 0"), share) for x in (s, d, h))

    def shrunk(bad, n, prior, k):
        return (F.col(bad) + prior * F.lit(k)) / (F.col(n) + F.lit(k))

    s = s.select("suffix", shrunk("bad", "n", F.lit(share), ks).alias("m_suffix"))
    d = d.join(s, "suffix").select("domain", shrunk("bad", "n", F.col("m_suffix"), kd).alias("m_domain"))
    mean = shrunk("bad", "n", F.col("m_domain"), kh)
    return h.join(d, "domain").select(
        "host", "pages", "n", "bad", mean.alias("mean"),
        F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(kh) + 1)).alias("sd"),
    )


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT, z: float = Z
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scores = reputations(pages, outcomes)
    judged = join_by_frequency(parsed, scores, "host", "pages", "left")
    bad = F.col("mean") - F.lit(z) * F.col("sd") > limit
    return judged.select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(says, F.when(bad, "block").otherwise("allow")).alias("verdict"),
    )
