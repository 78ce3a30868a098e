"""URL filter: rules by host and path, and for the rest the reputation of the host.

Labelled pages are outcomes of their host. Few outcomes say little, so the rate of bad pages is shrunk: a host
towards its registered domain, the domain towards its suffix, the suffix towards all pages, each by a beta prior whose
strength is estimated from the spread among siblings (method of moments for the beta-binomial). A host is blocked
if the lower bound of its posterior rate is above a limit. Everything here is DataFrame functions; only rates of hosts
meet the pages.

Reputations belong to sites: the host without user name, port and closing dot. An address in numbers is its own domain,
below the suffix ADDRESSES. Other sites have the longest public suffix that fits, or their last label, and one more
label as registered domain.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorica.llm.common import stored

# Verdict and rule.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
# Public suffixes of several labels, where registration is open below them.
PUBLIC_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au",
    "ac.nz", "co.nz", "net.nz", "org.nz", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "com.br", "gov.br", "net.br", "org.br",
    "ac.in", "co.in", "gov.in", "net.in", "org.in", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "co.kr", "or.kr",
    "ac.za", "co.za", "org.za", "com.ar", "com.mx", "com.tr", "com.tw", "com.hk", "com.sg", "co.il", "org.il", "com.ua",
)
ADDRESSES = "(address)"
PLAN_RULES = 200
DEVIATIONS = 1.645
BAD_RATE = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _listed(spark: SparkSession, rows: list[dict[str, str]], schema: str) -> DataFrame:
    """A frame of given rows out of one literal, so that no Python data source is in the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def with_parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, site). A null url or one without :// has an empty host, path and site."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    site = F.regexp_replace(F.substring_index("host", "@", -1), r"(:[0-9]*)?$", "")
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    return parts.withColumn("site", F.regexp_replace(site, r"\.$", ""))


def _last_labels(name: str, count: Column) -> Column:
    return F.call_function("substring_index", F.col(name), F.lit("."), -count)


def with_domains(sites: DataFrame, suffixes: Sequence[str] | DataFrame = PUBLIC_SUFFIXES) -> DataFrame:
    """`sites` (site and other columns, one row per site) with its domain and suffix.

    `suffixes` are public suffixes of two labels and more, a sequence or a frame with column `suffix`; wildcards must be
    written out. The ends of a site meet them in a join, the longest wins. A site that is a suffix is its own domain.
    """
    if not isinstance(suffixes, DataFrame):
        suffixes = _listed(sites.sparkSession, [{"suffix": s} for s in suffixes], "suffix string")
    known = suffixes.select("suffix").distinct()
    most = known.agg(F.coalesce(F.max(F.size(F.split("suffix", r"\."))), F.lit(0))).scalar()
    numbers = F.col("site").rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[.*\]$")
    labels = sites.select("site", F.size(F.split("site", r"\.")).alias("n"), numbers.alias("numbers"))
    upto = F.least("n", most)
    ends = labels.where(~numbers & (upto >= 2)).select("site", F.explode(F.sequence(F.lit(2), upto)).alias("k"))
    ends = ends.withColumn("suffix", _last_labels("site", F.col("k")))
    longest = ends.join(known, "suffix").groupBy("site").agg(F.max("k").alias("k"))
    k = F.coalesce("k", F.lit(1))
    own = sites.withColumn("numbers", numbers).join(longest, "site", "left")
    domain = F.when(F.col("numbers"), F.col("site")).otherwise(_last_labels("site", k + 1))
    suffix = F.when(F.col("numbers"), ADDRESSES).otherwise(_last_labels("site", k))
    return own.withColumns({"domain": domain, "suffix": suffix}).drop("k", "numbers")


def rule_match(rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest (verdict, rule) that fits host and path, else null. The rules are part of the plan.

    Of rules that are equal, the one whose verdict comes first in the alphabet counts.
    """
    whens = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        host, _, path = rule.partition("/")
        fits = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits = fits & F.startswith("path", F.lit("/" + path))
        whens.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*whens) if whens else F.lit(None).cast("struct<verdict:string,rule:string>")


def with_rules(parts: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame = RULES) -> DataFrame:
    """`parts` with `match`, as `rule_match` finds it, for any number of rules (verdict, rule).

    A frame, or more rules than fit a plan, meet distinct (host, path) in two joins: the ends of the host find the lengths
    of path for which rules exist, and end and prefix of such a length then find at most one rule.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= PLAN_RULES:
            return parts.withColumn("match", rule_match(rules))
        rows = [{"verdict": verdict, "rule": rule} for verdict, rule in rules]
        rules = _listed(parts.sparkSession, rows, "verdict string, rule string")
    slash = F.locate("/", F.col("rule"))
    split = rules.select(
        "verdict",
        "rule",
        F.substring_index("rule", "/", 1).alias("end"),
        F.when(slash > 0, F.substr("rule", slash)).otherwise("/").alias("prefix"),
    )
    known = split.groupBy("end", "prefix").agg(F.min_by(F.struct("verdict", "rule"), F.struct("rule", "verdict")).alias("match"))
    known = stored(known, "rules")
    lengths = known.groupBy("end").agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("lengths"))
    most = known.agg(F.coalesce(F.max(F.size(F.split("end", r"\."))), F.lit(0))).scalar()
    upto = F.least(F.size(F.split("host", r"\.")), most)
    places = parts.select("host", "path").distinct()
    ends = places.where(upto >= 1).select("host", "path", F.explode(F.sequence(F.lit(1), upto)).alias("k"))
    ends = ends.withColumn("end", _last_labels("host", F.col("k"))).join(lengths, "end")
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    prefixes = ends.select("host", "path", "end", F.explode(fitting).alias("n"))
    prefixes = prefixes.withColumn("prefix", F.substr("path", F.lit(1), F.col("n")))
    longest = F.struct((-F.length("match.rule")).alias("n"), F.col("match.rule").alias("rule"))
    found = prefixes.join(known, ["end", "prefix"]).groupBy("host", "path").agg(F.min_by("match", longest).alias("match"))
    return parts.join(found, ["host", "path"], "left")


def _shrunk(children: DataFrame, name: str, parent: str) -> DataFrame:
    """Rows (name, parent, n, bad, prior) with the posterior `rate` and the `strength` behind it.

    The strength is one number for the level, from the spread of the children's rates around their priors.
    """
    n, p = F.col("n").cast("double"), F.col("prior")
    seen = F.sum(n)
    excess = F.sum(F.pow(F.col("bad") - n * p, 2) / n) - F.sum(p * (1 - p))
    inside = F.sum(n * p * (1 - p)) - F.sum(p * (1 - p))
    spread = F.greatest(excess / F.greatest(inside, F.lit(1e-12)), F.lit(1e-9))
    strength = F.when(
        seen > 0, F.least(F.greatest(1 / spread - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))
    ).otherwise(F.lit(MOST_STRENGTH))
    level = children.where("n > 0").agg(F.round(F.coalesce(strength, F.lit(MOST_STRENGTH)), 6).alias("strength"))
    known = children.withColumn("strength", level.scalar())
    rate = (F.col("strength") * F.col("prior") + F.col("bad")) / (F.col("strength") + F.col("n"))
    return known.withColumn("rate", F.round(rate, 9)).select(name, parent, "n", "bad", "strength", "rate")


def reputations(parts: DataFrame, labels: DataFrame, suffixes: Sequence[str] | DataFrame = PUBLIC_SUFFIXES) -> DataFrame:
    """(site, n, bad, rate, low): outcomes of each site, shrunk rate of bad pages, lower posterior bound.

    `labels` (doc_id, quality, toxic): a page is bad if its quality is 0 or it is toxic. Repeated labels of a
    page count once, as bad if any says so; labels without a page are ignored. Sites without
    outcomes have the rate of their domain.
    """
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    outcomes = labels.where("quality is not null or toxic is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    joined = parts.select("page_id", "site").join(outcomes, F.col("page_id") == F.col("doc_id"), "left")
    sites = joined.groupBy("site").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    sites = stored(with_domains(stored(sites, "sites"), suffixes), "domains")

    def summed(*keys: str) -> DataFrame:
        return sites.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    overall = sites.agg(F.coalesce(F.round(F.try_divide(F.sum("bad") + 0.5, F.sum("n") + 1.0), 9), F.lit(0.5)))
    ends = _shrunk(summed("suffix").withColumns({"root": F.lit(""), "prior": overall.scalar()}), "suffix", "root")
    domains = summed("domain", "suffix").join(ends.select("suffix", F.col("rate").alias("prior")), "suffix")
    domains = _shrunk(domains, "domain", "suffix")
    above = domains.select("domain", "suffix", F.col("rate").alias("prior"))
    rated = _shrunk(sites.join(above, ["domain", "suffix"]), "site", "domain")
    total = F.col("strength") + F.col("n")
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (total + 1))
    return rated.select("site", "n", "bad", "rate", F.round(F.col("rate") - DEVIATIONS * deviation, 6).alias("low"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] | DataFrame = RULES,
    suffixes: Sequence[str] | DataFrame = PUBLIC_SUFFIXES,
) -> DataFrame:
    """page_id, host, path, rule, verdict of every page: the rule's verdict, else by the reputation of its site.

    `rules` (verdict, rule) and `suffixes` are sequences or frames of any length. Pages with an empty host belong to the
    site ''. Repeated rows are judged each; a null page_id has no outcome. Without pages the result is empty, without labels
    every page that no rule fits is allowed. Long urls and columns besides url and page_id need no care.
    """
    parts = with_parts(pages)
    rated = stored(reputations(parts, labels, suffixes).select("site", "low"), "reputations")
    found = with_rules(parts, rules).join(rated, "site", "left")
    learned = F.when(F.col("low") > BAD_RATE, "block").otherwise("allow")
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("match.rule").alias("rule"),
        F.coalesce(F.col("match.verdict"), learned).alias("verdict"),
    )
