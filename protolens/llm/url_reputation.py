"""URL filter: rules first, then empirical-Bayes reputation of hosts.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's; the longest
wins (ties: the longer host; the same host and path twice: block).  Fitting is by equality: for each host the lengths
of the rule paths under its suffixes are known, and a url asks for its path's prefixes of these lengths only.

Pages that rules decide are the labelled outcomes, with any labelled counts given besides.  The block rate of a host is
shrunk towards its registered domain's, that to its public suffix', that to the rate of all:

    rate = (blocked + s * parent's rate) / (pages + s),      s = 1 / rho - 1

with the overdispersion rho of each level fitted by moments over its units, between 1/1001 and 1/2:

    rho = sum((k - n m)^2 - n m (1 - m)) / sum(n (n - 1) m (1 - m)),      m = parent's rate

A host's posterior is the beta distribution of k + s m and n - k + s (1 - m); a url without a rule is blocked where the
lower bound of its host's block rate, mean less ``z`` standard deviations, is above ``most_blocked``.

Everything is DataFrame functions over distinct (host, path) with page counts, so a hot host, a hot url or a suffix that
holds half of all domains is one row with a count; such keys meet their parents by broadcast (``hot_join``).

Edge cases: a null url or one without '://' has an empty host and path, fits no rule and gets the rate of all; repeated
rows count each and get a row each; without labelled pages nothing is blocked; other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolens.llm.common import hot_join, prepare, written

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: public suffixes of two labels (fixed values; a longer list is a parameter)
SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "org.uk")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), A_Z, a_z)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def _labels(host: Column) -> Column:
    """Labels of the name in a host, without port, user and final dot."""
    return F.split(F.regexp_replace(host, r"^.*@|:[0-9]*$|\.(?=$|:)", ""), r"\.")


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    labels = _labels(host)
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    return F.when(two.isin(*suffixes), two).otherwise(F.element_at(labels, -1)) if suffixes else F.element_at(labels, -1)


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Public suffix and one label more (the whole name where there is none)."""
    labels = _labels(host)
    n = F.size(F.split(suffix_of(host, suffixes), r"\.")) + 1
    return F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of the distinct (host, path) of ``urls`` that a rule fits."""
    rules = rules.select(F.translate(F.col("host"), A_Z, a_z).alias("under"), F.col("path").alias("prefix"), F.col("verdict"))
    rules = rules.groupBy("under", "prefix").agg(F.max("verdict").alias("rule_verdict"))  # 'block' > 'allow'
    lengths = rules.groupBy("under").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    labels = F.split("host", r"\.")
    hosts = (urls.select("host").distinct()
             .select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                                   lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("under"))
             .join(lengths, "under"))
    hosts = written(hosts.groupBy("host").agg(F.collect_list(F.struct("under", "lengths")).alias("keys")), "url-hosts")
    sizes = urls.groupBy("host").agg(F.count("*").alias("urls"))
    known = sizes.join(hosts, "host", "left")  # every host, so that a hot one without rules is known to be hot
    asked = (hot_join(urls, known, ["host"], "urls", urls.count()).where("keys is not null")
             .select("host", "path", F.explode("keys").alias("k"))
             .select("host", "path", F.col("k.under").alias("under"), F.explode("k.lengths").alias("n"))
             .where(F.col("n") <= F.length("path"))
             .select("host", "path", "under", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("prefix")))
    found = asked.join(rules, ["under", "prefix"])
    best = F.max(F.struct((F.length("under") + F.length("prefix")).alias("size"), F.length("under").alias("wide"),
                          F.concat("under", "prefix").alias("rule"), "rule_verdict"))
    return found.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.rule_verdict")


def _strength(units: DataFrame) -> float:
    """Prior strength s of a level: units (n, k, m) by the moments of the beta-binomial distribution."""
    spread = F.col("m") * (1 - F.col("m"))
    row = units.where("n > 0").agg(
        F.sum((F.col("k") - F.col("n") * F.col("m")) * (F.col("k") - F.col("n") * F.col("m")) - F.col("n") * spread).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("base")).first()
    rho = row["over"] / row["base"] if row["base"] else 0.5
    return 1 / min(max(rho, 1 / 1001), 0.5) - 1


def _shrunk(units: DataFrame, s: float) -> Column:
    return (F.col("k") + s * F.col("m")) / (F.col("n") + s)


def reputations(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, block_rate, deviation) from (host, n labelled pages, k of them blocked)."""
    hosts = written(hosts.select("host", domain_of(F.col("host"), suffixes).alias("domain"),
                                 suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "k"), "url-hosts-counted")
    domains = written(hosts.groupBy("domain").agg(F.max("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k"),
                                                  F.count("*").alias("below")), "url-domains")
    level = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("below"))
    total = level.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("below").alias("domains")).first()
    if total["n"] is None:  # no host at all
        return hosts.select("host", F.lit(0.0).alias("block_rate"), F.lit(0.0).alias("deviation"))
    level = written(level.withColumn("m", F.lit((total["k"] + 1) / (total["n"] + 2))), "url-suffixes")
    level = level.select("suffix", "below", _shrunk(level, _strength(level)).alias("m"))
    domains = written(hot_join(domains.withColumnRenamed("below", "hosts"), level, ["suffix"], "below", total["domains"]).drop("below"),
                      "url-domains-prior")
    level = domains.select("domain", F.col("hosts").alias("below"), _shrunk(domains, _strength(domains)).alias("m"))
    units = written(hot_join(hosts, level, ["domain"], "below", hosts.count()).drop("below"), "url-hosts-prior")
    s = _strength(units)
    a, b = F.col("k") + s * F.col("m"), F.col("n") - F.col("k") + s * (1 - F.col("m"))
    return units.select("host", (a / (a + b)).alias("block_rate"),
                        F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def judge(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, z: float = 1.645, most_blocked: float = 0.5,
          suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_rate, block_bound of every page.

    ``rules``: host, path, verdict ('allow' or 'block').  ``labelled``: host, n, k of pages judged elsewhere."""
    prepare(pages.sparkSession)
    rows = written(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "url-pages")
    urls = written(rows.groupBy("host", "path").agg(F.count("*").alias("pages")), "url-urls")
    ruled = written(match_rules(urls.select("host", "path"), rules), "url-ruled")
    ruled_urls = urls.join(ruled, ["host", "path"], "left")
    outcome = F.when(F.col("rule").isNotNull(), F.col("pages")).otherwise(0)
    hosts = ruled_urls.groupBy("host").agg(F.sum(outcome).alias("n"),
                                           F.sum(F.when(F.col("rule_verdict") == "block", F.col("pages")).otherwise(0)).alias("k"),
                                           F.count("*").alias("urls"))
    hosts = written(hosts, "url-outcomes")
    counts = hosts.select("host", "n", "k")
    if labelled is not None:
        more = labelled.select(F.translate(F.col("host"), A_Z, a_z).alias("host"), F.col("n").cast("long"), F.col("k").cast("long"))
        counts = counts.unionByName(more).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    known = reputations(counts, suffixes).join(hosts.select("host", "urls"), "host")
    bound = F.col("block_rate") - z * F.col("deviation")
    judged = hot_join(ruled_urls, known, ["host"], "urls", urls.count()).select(
        "host", "path", "pages", "rule",
        F.coalesce("rule_verdict", F.when(bound > most_blocked, "block").otherwise("allow")).alias("verdict"),
        "block_rate", bound.alias("block_bound"))
    judged = written(judged, "url-judged")
    return hot_join(rows, judged, ["host", "path"], "pages", rows.count()).select(
        "page_id", "host", "path", "rule", "verdict", "block_rate", "block_bound")
