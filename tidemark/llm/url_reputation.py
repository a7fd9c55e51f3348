"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Outcomes (1 good, 0 bad) of labelled pages are counted per host. Counts shrink through beta priors
from the top down: the prior of a suffix is centred on the rate of all pages, that of a registered
domain on its suffix's posterior mean, that of a host on its domain's. The strength of each level's
prior is estimated by the method of moments from the spread of the rates below it. A page is blocked
when even the upper bound of its host's posterior, mean plus ``z`` standard deviations, lies below the cut:
the rate whose odds of a good page are those of all pages divided by ``worse``. So the cut moves with the
pages at hand, and a host falls by evidence of its own, not for want of it.

All of it is DataFrame work: outcomes are added up per host before anything is joined, so a host with
a third of all pages is one row, and pages meet the host table in one join.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule and the verdict
of the prior alone; hosts without outcomes take their domain's, suffix's or the overall prior; with
no outcomes at all the rate is 1/2; outcomes that are neither 0 nor 1 are left out, repeated ones
count each; repeated or null page ids give a row each; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query
from .support import stage, table

# fixed values of the contract: (verdict, host, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Public suffixes of two labels; all others have one. A parameter of ``reputation``.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz"]
WORSE, Z = 2.0, 1.645
#: Bounds of a prior's strength, in pages. The lower one keeps empty hosts defined.
WEAKEST, STRONGEST = 2.0, 1000.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does. Equal lengths: the first listed."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        text = F.when(fits, rule_host + prefix).otherwise(text)
        verdict = F.when(fits, kind).otherwise(verdict)
    return text, verdict


def levels(host: Column, two_label: list[str]) -> tuple[Column, Column]:
    """Suffix and registered domain of a host."""
    labels = F.split(host, r"\.")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), k), ".")
    two = last(2).isin(two_label)
    return F.when(two, last(2)).otherwise(last(1)), F.when(two, last(3)).otherwise(last(2))


def _shrunk(counts: DataFrame, key: str, parent: DataFrame | None, parent_key: str | None, start: dict) -> DataFrame:
    """Posterior (a, b) of each key: its good and bad counts on top of a prior centred on the parent's mean.

    Strength by moments: with n trials in k groups around their centres, the excess of the weighted
    squared distance over the binomial one gives the spread of the true rates.
    """
    if parent is None:
        joined = counts.withColumn("centre", F.lit(start["rate"]))
    else:
        joined = counts.join(parent.select(parent_key, (F.col("a") / (F.col("a") + F.col("b"))).alias("centre")), parent_key)
    n, rate = F.col("good") + F.col("bad"), F.col("good") / (F.col("good") + F.col("bad"))
    chance = F.col("centre") * (1 - F.col("centre"))
    excess = joined.filter(n > 1).agg(
        F.sum(n * (rate - F.col("centre")) ** 2).alias("seen"), F.sum(chance).alias("expected"),
        F.sum((n - 1) * chance).alias("weight"),
    )
    rho = (F.col("seen") - F.col("expected")) / F.col("weight")
    strength = excess.select(
        F.when(F.col("weight").isNull() | (F.col("weight") <= 0) | (rho <= 1 / (STRONGEST + 1)), F.lit(STRONGEST))
        .otherwise(F.greatest(1 / rho - 1, F.lit(WEAKEST))).alias("strength")
    )
    return joined.withColumn("strength", F.lit(strength.first()[0])).withColumns({
        "a": F.col("centre") * F.col("strength") + F.col("good"),
        "b": (1 - F.col("centre")) * F.col("strength") + F.col("bad"),
    })


def reputation(outcomes: DataFrame, two_label: list[str] = TWO_LABEL_SUFFIXES) -> dict:
    """Posteriors per host, domain and suffix from rows (host, good) and the overall rate."""
    suffix, domain = levels(F.col("host"), two_label)
    hosts = outcomes.filter(F.col("good").isin(0, 1)).groupBy("host").agg(
        F.sum(F.col("good").cast("double")).alias("good"), F.sum(1.0 - F.col("good")).alias("bad")
    )
    hosts = stage(hosts.withColumns({"suffix": suffix, "domain": domain}), "host-outcomes")
    summed = lambda *keys: hosts.groupBy(*keys).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    good, bad = hosts.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    start = {"rate": (good + 1) / (good + bad + 2)}
    suffixes = stage(_shrunk(summed("suffix"), "suffix", None, None, start), "suffix-prior")
    domains = stage(_shrunk(summed("domain", "suffix"), "domain", suffixes, "suffix", start), "domain-prior")
    return {"host": _shrunk(hosts, "host", domains.drop("suffix"), "domain", start), "domain": domains, "suffix": suffixes, "start": start}


def url_filter(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, worse: float = WORSE, z: float = Z,
    two_label: list[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """Judge every page's url. ``outcomes`` has rows (host, good).

    Distinct hosts are judged once, pages then take their host's bound.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    suffix, domain = levels(F.col("host"), two_label)
    found = reputation(outcomes, two_label)
    seen = pages.select(host.alias("host")).distinct().withColumns({"suffix": suffix, "domain": domain})
    named = lambda df, key, p: df.select(F.col(key), F.col("a").alias(f"{p}a"), F.col("b").alias(f"{p}b"), F.col("strength").alias(f"{p}s"))
    hosts = named(found["host"], "host", "h").join(seen, "host", "right")
    hosts = hosts.join(named(found["domain"], "domain", "d"), "domain", "left").join(named(found["suffix"], "suffix", "s"), "suffix", "left")
    # a host without outcomes keeps its parent's mean, at the strength of the parent's own prior
    mean = F.coalesce(*[F.col(f"{p}a") / (F.col(f"{p}a") + F.col(f"{p}b")) for p in "hds"], F.lit(found["start"]["rate"]))
    size = F.coalesce(F.col("ha") + F.col("hb"), F.col("ds"), F.col("ss"), F.lit(WEAKEST))
    bound = mean + F.lit(z) * F.sqrt(mean * (1 - mean) / (size + 1))
    rate = found["start"]["rate"]
    cut = rate / (rate + (1 - rate) * worse)
    # written, so that the join below spreads both sides anew and Spark can split a host with very many pages
    hosts = stage(hosts.select("host", mean.alias("posterior_mean"), bound.alias("posterior_bound")), "host-bounds")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .join(hosts, "host")
        .select(
            F.col("page_id").cast("long").alias("page_id"), "host", "path", text.alias("rule"),
            F.coalesce(verdict, F.when(F.col("posterior_bound") >= cut, "allow").otherwise("block")).alias("verdict"),
            F.round("posterior_mean", 9).alias("posterior_mean"), F.round("posterior_bound", 9).alias("posterior_bound"),
        )
    )


def labelled_hosts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of the labelled pages: ``labels`` is keyed by the number that pages carry as ``page_id``."""
    good = labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    host, _ = host_and_path(F.col("url").cast("string"))
    return pages.select("page_id", host.alias("host")).join(good, "page_id").select("host", "good")


_LEVEL = """
{k}_in AS (SELECT c.*, {centre} AS centre FROM {counts} c {join}),
{k}_rho AS (SELECT sum((good + bad) * power(good / (good + bad) - centre, 2)) AS seen, sum(centre * (1 - centre)) AS expected,
    sum((good + bad - 1) * centre * (1 - centre)) AS weight FROM {k}_in WHERE good + bad > 1),
{k}_k AS (SELECT CASE WHEN weight IS NULL OR weight <= 0 OR (seen - expected) / weight <= 1 / 1001.0::DOUBLE THEN 1000.0::DOUBLE
    ELSE greatest(1 / ((seen - expected) / weight) - 1, 2.0::DOUBLE) END AS strength FROM {k}_rho),
{k}_post AS (SELECT {key} AS {key}, strength, centre * strength + good AS a, (1 - centre) * strength + bad AS b FROM {k}_in, {k}_k)"""


def _sql() -> str:
    parent = lambda k: f"(SELECT a / (a + b) FROM {k}_post x WHERE x.{k} = c.{k})"
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    lv = lambda k: _LEVEL.format(**k)
    fits = [(v, h, p) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    cond = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = "CASE " + " ".join(f"WHEN {cond(h, p)} THEN '{h}{p}'" for v, h, p in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {cond(h, p)} THEN '{v}'" for v, h, p in fits)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p0 AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
p1 AS (SELECT *, string_split(host, '.') AS ls FROM p0),
p2 AS (SELECT *, array_to_string(ls[-2:], '.') IN ({two}) AS two FROM p1),
p AS (SELECT page_id, host, path, array_to_string(CASE WHEN two THEN ls[-2:] ELSE ls[-1:] END, '.') AS suffix,
    array_to_string(CASE WHEN two THEN ls[-3:] ELSE ls[-2:] END, '.') AS domain FROM p2),
hc AS (SELECT host, suffix, domain, sum(quality)::DOUBLE AS good, sum(1 - quality)::DOUBLE AS bad
    FROM p JOIN labels ON doc_id = page_id WHERE quality IN (0, 1) GROUP BY ALL),
sc AS (SELECT suffix, sum(good) AS good, sum(bad) AS bad FROM hc GROUP BY ALL),
dc AS (SELECT domain, suffix, sum(good) AS good, sum(bad) AS bad FROM hc GROUP BY ALL),
st AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(good), 0) + coalesce(sum(bad), 0) + 2) AS rate FROM hc),
{lv(dict(k='suffix', key='suffix', counts='sc', centre='(SELECT rate FROM st)', join=''))},
{lv(dict(k='domain', key='domain', counts='dc', centre=parent('suffix'), join=''))},
{lv(dict(k='host', key='host', counts='hc', centre=parent('domain'), join=''))},
j AS (SELECT p.page_id, p.host, p.path, coalesce(h.a / (h.a + h.b), d.a / (d.a + d.b), s.a / (s.a + s.b), (SELECT rate FROM st)) AS m,
    coalesce(h.a + h.b, d.strength, s.strength, 2.0) AS n
    FROM p LEFT JOIN host_post h ON h.host = p.host LEFT JOIN domain_post d ON d.domain = p.domain LEFT JOIN suffix_post s ON s.suffix = p.suffix)
SELECT page_id, host, path, {rule} AS rule, {verdict} WHEN m + {Z} * sqrt(m * (1 - m) / (n + 1)) >= (SELECT rate / (rate + (1 - rate) * {WORSE}) FROM st) THEN 'allow' ELSE 'block' END AS verdict,
    round(m, 9) AS posterior_mean, round(m + {Z} * sqrt(m * (1 - m) / (n + 1)), 9) AS posterior_bound FROM j"""


@query("op4_url_reputation", _sql())
def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, labelled_hosts(pages, table(spark, sf_dir, "labels")))
