"""URL filters: rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host.  Rates are shrunk from
the whole table to suffix, to registered domain, to host: each level has a beta
prior around its parent's posterior mean, whose weight is estimated from the
spread of the level's own rates.  A host is blocked if even the lower bound of
its posterior rate is above a threshold.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels below which names are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk")


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user and port: what a reputation belongs to."""
    return F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*$", "")


def with_domains(names: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Add the ``suffix`` and the registered ``domain`` (suffix and one label) of each ``name``; addresses stay whole.

    ``suffixes`` has a column ``suffix``, of any number of labels; the longest
    that ends a name counts, else its last label.  Without it the built-in list
    of two labels is used.
    """
    address = F.col("name").rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$")
    if suffixes is None:
        labels = F.when(F.substring_index("name", ".", -2).isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)
        names = names.withColumn("_labels", labels)
    else:
        ends = names.select("name").distinct().withColumn("_labels", F.explode(F.sequence(F.lit(1), F.size(F.split("name", r"\.")))))
        ends = ends.withColumn("suffix", F.expr("substring_index(name, '.', -_labels)")).join(suffixes.select("suffix"), "suffix", "left_semi")
        longest = ends.groupBy("name").agg(F.max("_labels").alias("_labels"))
        names = names.join(longest, "name", "left").withColumn("_labels", F.coalesce("_labels", F.lit(1)))
    end = lambda more: F.when(address, F.col("name")).otherwise(F.expr(f"substring_index(name, '.', -(_labels + {more}))"))
    return names.withColumns({"suffix": end(0), "domain": end(1)}).drop("_labels")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict, null if none fits; rules are (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _weight(level: DataFrame) -> float:
    """Prior weight of a level from the spread of its rates around their parents (method of moments)."""
    mean_variance = F.col("mean") * (1 - F.col("mean"))
    row = level.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2)).alias("spread"),
        F.sum(mean_variance).alias("expected"), F.sum(mean_variance * (F.col("n") - 1)).alias("slope"),
    ).first()
    if not row["slope"]:
        return 1e6
    within = min(max((row["spread"] - row["expected"]) / row["slope"], 1e-6), 0.999)
    return 1 / within - 1


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """Posterior bad rate of each name: ``name, n, bad, rate, lower``.

    ``pages`` has ``page_id, name``; ``outcomes`` has ``page_id, bad`` (0/1).
    Names without labelled pages have the posterior of their domain.
    """
    counts = (
        pages.join(outcomes, "page_id", "left").groupBy("name")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    counts = with_domains(counts, suffixes)
    counts = written(counts, "host-counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)

    def shrunk(level: DataFrame) -> DataFrame:
        weight = _weight(level)
        alpha, beta = F.col("mean") * weight + F.col("bad"), (1 - F.col("mean")) * weight + F.col("n") - F.col("bad")
        return level.withColumns({"alpha": alpha, "beta": beta}).withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta")))

    def of(key: str, parents: DataFrame | None, parent: str) -> DataFrame:
        level = counts.groupBy(*dict.fromkeys([key, parent])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        return shrunk(level.withColumn("mean", F.lit(mean)) if parents is None else level.join(parents.select(parent, F.col("rate").alias("mean")), parent))

    suffixes = of("suffix", None, "suffix")
    domains = of("domain", suffixes, "suffix")
    hosts = of("name", domains, "domain")
    size = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (size * size * (size + 1)))
    return hosts.select("name", "n", "bad", "rate", (F.col("rate") - z * deviation).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url",
               suffixes: DataFrame | None = None) -> DataFrame:
    """Verdict of each page: ``id, host, path, rule, verdict, rate, lower``.

    A rule ``host/path`` fits its host and all subdomains if the url's path
    starts with the rule's path; the longest fitting rule decides.  Otherwise a
    page is blocked if the lower posterior bound of its host's bad rate is above
    ``threshold``.

    A host's reputation does not depend on user and port; addresses are their own
    domain and suffix.  ``suffixes`` (see ``with_domains``) says below which names
    domains are registered.

    ``outcomes`` is ``id, bad`` with one row per labelled page.  Null urls and
    urls without ``://`` have empty host and path and share one reputation.
    Repeated rows each get a verdict and, if labelled, each count.  Without any
    outcome every rate is one half and nothing is blocked.  Further columns are
    ignored; an empty table gives an empty result.
    """
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("name", name_of(F.col("host")))
    known = reputation(parsed.select("page_id", "name"), outcomes.toDF("page_id", "bad").where("bad IS NOT NULL"), suffixes=suffixes)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.join(known.select("name", "rate", "lower"), "name", "left").withColumns({"rule": rule, "verdict": verdict})
    own = F.when(F.col("lower") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "rate", "lower")
