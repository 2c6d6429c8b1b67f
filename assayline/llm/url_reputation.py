"""Operator 3: empirical-Bayes host reputation for URL filtering.

Labelled page outcomes (good or bad) are counted per host and rolled up to the
registered domain (last two labels of the host) and its suffix (last label).
Each level has a beta-binomial model: its concentration is estimated from the
spread of the children's rates around their parent's rate (method of moments,
weighted by outcomes), and a child's posterior is Beta(good + k m, bad + k
(1 - m)), m being the posterior mean of its parent. A url is blocked when the
lower posterior bound of its host's good rate (mean - z sd) is under
``threshold``; explicit allow and block rules come first.

Outcome of a page: the label of the document with the page's id; good when
quality is 1 and toxic is 0. Rows without both labels say nothing; several
labels of one id each count.

Defined cases: a null url or one without ``://`` has empty host and path (and
is judged as an unknown host of an unknown suffix); an unseen host takes its
domain's posterior as prior with no outcomes of its own, and so on upwards;
without any labelled page the global rate is 0.5; an empty table gives an
empty result; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import lower_ascii, stored, table

#: (host, path, verdict): fixed values of the rule list.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block"))
Z, THRESHOLD = 1.645, 0.5
K_LOW, K_HIGH = 2.0, 10_000.0
SALTS = 8


def parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _levels(host: str = "host") -> list[Column]:
    return [F.substring_index(host, ".", -2).alias("domain"),
            F.substring_index(host, ".", -1).alias("suffix")]


def _concentration(rates: DataFrame) -> float:
    """Concentration of children with (n, good, m), m being the parent's raw
    rate: five sums, combined before the shuffle, reach the driver."""
    p = F.col("good") / F.col("n")
    r = rates.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("t2"),
                  F.count(F.lit(1)).alias("c"),
                  F.sum(F.col("n") * (p - F.col("m")) * (p - F.col("m"))).alias("between"),
                  F.sum(F.col("n") * p * (1 - p)).alias("within")).first()
    if r.c < 2 or r.t <= r.c:
        return K_HIGH
    msb, msw = r.between / (r.c - 1), r.within / (r.t - r.c)
    if msb <= msw:
        return K_HIGH
    n0 = (r.t - r.t2 / r.t) / (r.c - 1)
    return max(K_LOW, min(K_HIGH, (msb + (n0 - 1) * msw) / (msb - msw) - 1))


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Posteriors from (host, good 0/1): tables host, domain, suffix with
    (key, a, b), and the global values m, kh, kd, ks. Counts are combined
    before the shuffle, so a hot host is one row a task."""
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"),
                                         F.sum(F.col("good").cast("double")).alias("good"))
    hosts = stored(hosts.select("host", *_levels(), "n", "good"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"),
                                                    F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    m = suffixes.agg(F.sum("good") / F.sum("n")).first()[0]
    m = 0.5 if m is None else m

    def raw(t: DataFrame, key: str) -> DataFrame:
        return t.select(key, (F.col("good") / F.col("n")).alias("m"))

    world = {"m": m, "ks": _concentration(suffixes.withColumn("m", F.lit(m))),
             "kd": _concentration(domains.join(raw(suffixes, "suffix"), "suffix")),
             "kh": _concentration(hosts.join(raw(domains, "domain"), "domain"))}

    def posterior(t: DataFrame, key: str, k: float) -> DataFrame:
        return t.select(key, (F.col("good") + k * F.col("m")).alias("a"),
                        (F.col("n") - F.col("good") + k * (1 - F.col("m"))).alias("b"))

    def mean(t: DataFrame, key: str) -> DataFrame:
        return t.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))

    s = posterior(suffixes.withColumn("m", F.lit(m)), "suffix", world["ks"])
    d = posterior(domains.join(mean(s, "suffix"), "suffix"), "domain", world["kd"])
    h = posterior(hosts.join(mean(d, "domain"), "domain"), "host", world["kh"])
    return h, d, s, world


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z,
          threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` (with host and path) plus rule, verdict and good_low, the
    lower posterior bound of the host's good rate."""
    h, d, s, world = reputation(outcomes)
    seen = pages.select("host").distinct().select("host", *_levels())
    # One row a distinct host: what a url of that host gets from the method.
    best = (seen.join(h.select("host", F.col("a").alias("ha"), F.col("b").alias("hb")),
                      "host", "left")
                .join(d.select("domain", F.col("a").alias("da"), F.col("b").alias("db")),
                      "domain", "left")
                .join(s.select("suffix", F.col("a").alias("sa"), F.col("b").alias("sb")),
                      "suffix", "left"))
    ms = F.coalesce(F.col("sa") / (F.col("sa") + F.col("sb")), F.lit(world["m"]))
    md = F.coalesce(F.col("da") / (F.col("da") + F.col("db")), ms)
    a = F.coalesce("ha", world["kh"] * md)
    b = F.coalesce("hb", world["kh"] * (1 - md))
    low = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    # A hot host's pages meet its one row in SALTS places.
    best = best.select("host", low.alias("good_low"), F.explode(
        F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("_ur_salt"))
    salted = pages.withColumn("_ur_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.round("good_low", 9) >= threshold, "allow").otherwise("block")
    return (salted.join(best, ["host", "_ur_salt"]).drop("_ur_salt").withColumn("rule", rule)
                  .withColumn("verdict", F.coalesce(verdict, own)))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of pages whose id has both labels."""
    own = labels.where("quality is not null and toxic is not null").select(
        F.col("doc_id").alias("page_id"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return pages.select("page_id", "host").join(own, "page_id").select("host", "good")


def op3_host_reputation(spark, sf_dir: str) -> DataFrame:
    host, path = parts(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    out = judge(pages, labelled_outcomes(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _k_sql(name: str, children: str) -> str:
    return f"""
{name}_s AS (
  SELECT sum(n) AS t, sum(n * n) AS t2, count(*) AS c,
         sum(n * (good / n - m) * (good / n - m)) AS between_,
         sum(n * (good / n) * (1 - good / n)) AS within_ FROM ({children})),
{name} AS (
  SELECT CASE WHEN c > 1 AND t > c THEN
    CASE WHEN between_ / (c - 1) <= within_ / (t - c) THEN {K_HIGH}
    ELSE greatest({K_LOW}, least({K_HIGH},
      (between_ / (c - 1) + ((t - t2 / t) / (c - 1) - 1) * within_ / (t - c))
      / (between_ / (c - 1) - within_ / (t - c)) - 1)) END
    ELSE {K_HIGH} END AS k FROM {name}_s)"""


SQL = rf"""
WITH u AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
             string_split(host, '.')[-1] AS suffix FROM p),
o AS (
  SELECT q.*, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g
  FROM q JOIN labels l ON l.doc_id = q.page_id
  WHERE quality IS NOT NULL AND toxic IS NOT NULL),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(g) AS good FROM o GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
w AS (SELECT coalesce(sum(good) / sum(n), 0.5) AS m FROM s),
{_k_sql("ks", "SELECT s.*, w.m FROM s, w")},
{_k_sql("kd", "SELECT d.*, s.good / s.n AS m FROM d JOIN s USING (suffix)")},
{_k_sql("kh", "SELECT h.*, d.good / d.n AS m FROM h JOIN d USING (domain)")},
sp AS (SELECT suffix, (good + ks.k * w.m) / (n + ks.k) AS m FROM s, w, ks),
dp AS (SELECT domain, (good + kd.k * sp.m) / (n + kd.k) AS m FROM d JOIN sp USING (suffix), kd),
hp AS (SELECT host, good + kh.k * dp.m AS a, n - good + kh.k * (1 - dp.m) AS b
       FROM h JOIN dp USING (domain), kh),
j AS (
  SELECT q.page_id, q.host, q.path,
         coalesce(hp.a, kh.k * coalesce(dp.m, sp.m, w.m)) AS a,
         coalesce(hp.b, kh.k * (1 - coalesce(dp.m, sp.m, w.m))) AS b
  FROM q LEFT JOIN hp USING (host) LEFT JOIN dp USING (domain) LEFT JOIN sp USING (suffix),
       w, kh),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%'
      THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%'
      THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM j)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN round(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9)
            >= {THRESHOLD} THEN 'allow' ELSE 'block' END AS verdict
FROM r
"""
