"""URL filters: curated rules, and host reputation by empirical Bayes for the rest.

Pages that a rule decides are labelled outcomes (or outcomes are given). Counts of
blocked among labelled pages shrink down a hierarchy: a suffix towards the whole
table's rate, a registered domain towards its suffix, a host towards its domain,
each as a beta-binomial whose prior mean is the parent's posterior mean. A level's
prior strength comes from the data by the method of moments: the correlation of
outcomes within its units, around their parents' rates. A host is blocked where the posterior's lower bound,
mean - z * deviation, is above `most_blocked`.

All of it is DataFrame aggregation and equi-joins. Outcomes are counted per host
first, so a host with a third of all pages is a few rows in the shuffle; joining
back is an ordinary join whose skewed partitions Spark may split. The driver
receives one row of sums per level.

A registered domain is a public suffix and the label before it. A suffix is the last
label, or one of several labels from the table `suffixes`, a parameter of up to some
hundreds of entries that becomes one pattern. Ports, what stands before an @, and dots at
the end do not count. An IP address is its own domain, under a suffix for addresses.

Edge cases: a null url, or one without ://, has empty host and path, which form a
host of their own; a host that is itself a suffix is its own domain; hosts without
outcomes get what their domain and suffix say; without any outcome every rate is
`unseen`; repeated pages count each; columns of pages travel as one, so no name of
theirs meets one from here, and those named like the result's are replaced. The rule
list is a parameter of tens of entries and becomes one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.llm.common import shared_folder, table

#: (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: Public suffixes of more than one label, the more common ones: fixed values.
SUFFIXES = (
    "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn",
    "edu.au", "edu.cn", "edu.hk", "edu.tw", "go.jp", "go.kr", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "gov.za", "ltd.uk", "me.uk",
    "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.nz", "org.uk", "org.za", "plc.uk", "sch.uk",
)
#: What IP addresses have for a suffix.
ADDRESS = "[address]"
IP = r"^([0-9]{1,3}([.][0-9]{1,3}){3}|\[.*\])$"
Z, MOST_BLOCKED, UNSEEN = 1.64, 0.5, 0.0
LEAST_RHO, MOST_RHO = 0.001, 0.999
PRIOR_RHO, PRIOR_ROOM = 0.1, 5.0


def host_and_path(url: str) -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(u, URL, 1), UPPER, LOWER), F.regexp_extract(u, URL, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; nulls where none does."""
    name = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = (name.when if name is not None else F.when)(fits, F.lit(h + p))
        verdict = (verdict.when if verdict is not None else F.when)(fits, F.lit(what))
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


#: What of a host counts: nothing up to an @, no port, no dots at the end.
EXTRAS = r"^.*@|:[0-9]*$"


def patterns(suffixes=SUFFIXES) -> tuple[str, str]:
    """Of the registered domain and of the suffix, in group 1 each; the leftmost match is the longest suffix."""
    known = "".join(f"{x.replace('.', '[.]')}|" for x in sorted(suffixes))
    return rf"(?:^|[.])([^.]+[.](?:{known}[^.]+))$", rf"(?:^|[.])({known}[^.]*)$"


def domain_and_suffix(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """The registered domain (the host itself where it has no label before its suffix) and the suffix."""
    domain, suffix = patterns(suffixes)
    bare = F.regexp_replace(F.regexp_replace(host, EXTRAS, ""), "[.]+$", "")
    address = bare.rlike(IP)
    two, last = F.regexp_extract(bare, domain, 1), F.regexp_extract(bare, suffix, 1)
    return F.when(address | (two == "") | (last == bare), bare).otherwise(two), F.when(address, F.lit(ADDRESS)).otherwise(last)


def rho(spread: float | None, chance: float | None, room: float | None) -> float:
    """Correlation of outcomes within units, given their parents' rates m.

    spread: sum of n (p - m)^2; chance: sum of m (1 - m), what spread would be without
    correlation; room: sum of (n - 1) m (1 - m), what it can add. Few outcomes say
    little, so PRIOR_RHO stands in with the weight of PRIOR_ROOM.
    """
    return min(MOST_RHO, max(LEAST_RHO, ((spread or 0.0) - (chance or 0.0) + PRIOR_RHO * PRIOR_ROOM) / ((room or 0.0) + PRIOR_ROOM)))


def _kappa(level: DataFrame, n: str, b: str, parent: Column) -> float:
    """The prior strength of a level's units around their parent's rate."""
    v, p = parent * (1 - parent), F.col(b) / F.col(n)
    s = level.where(F.col(n) > 0).agg(F.sum(F.col(n) * (p - parent) * (p - parent)).alias("spread"), F.sum(v).alias("chance"), F.sum((F.col(n) - 1) * v).alias("room")).first()
    return 1 / rho(s["spread"], s["chance"], s["room"]) - 1


def reputations(outcomes: DataFrame, z: float = Z, most_blocked: float = MOST_BLOCKED, unseen: float = UNSEEN, suffixes=SUFFIXES) -> DataFrame:
    """For each host: posterior, bound and verdict, from rows (host, blocked: 0, 1 or null)."""
    shared_folder(outcomes.sparkSession)
    hosts = outcomes.groupBy("host").agg(F.count("blocked").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"))
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix).checkpoint()
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("b").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    g = suffixes.agg(F.sum("sn").alias("n"), F.sum("sb").alias("b")).first()
    rate = g["b"] / g["n"] if g["n"] else unseen
    met = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix")
    kappa = [_kappa(suffixes, "sn", "sb", F.lit(rate)), _kappa(domains.join(suffixes, "suffix"), "dn", "db", F.col("sb") / F.col("sn")), _kappa(met, "n", "b", F.col("db") / F.col("dn"))]
    shrunk = lambda b, n, k, parent: (F.col(b) + k * parent) / (F.col(n) + k)
    met = met.withColumn("suffix_rate", shrunk("sb", "sn", F.lit(kappa[0]), F.lit(rate)))
    met = met.withColumn("domain_rate", shrunk("db", "dn", F.lit(kappa[1]), F.col("suffix_rate")))
    met = met.withColumn("posterior", shrunk("b", "n", F.lit(kappa[2]), F.col("domain_rate")))
    bound = F.col("posterior") - z * F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("n") + kappa[2] + 1))
    return met.withColumn("bound", bound).select("host", "n", "b", "posterior", "bound", F.when(F.col("bound") > most_blocked, "block").otherwise("allow").alias("reputation"))


def judge(pages: DataFrame, rules=RULES, outcomes: DataFrame | None = None, url: str = "url", **how) -> DataFrame:
    """Adds host, path, rule, verdict; outcomes (host, blocked) replace the rules' own if given. how: as for reputations."""
    host, path = host_and_path(url)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    cut = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("page"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    cut = cut.withColumn("rule", rule).withColumn("ruled", verdict)
    own = cut.select("host", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).alias("blocked"))
    if outcomes is not None:  # every host is asked about, also those without an outcome
        own = cut.select("host", F.lit(None).cast("int").alias("blocked")).unionByName(outcomes.select("host", F.col("blocked").cast("int").alias("blocked")))
    met = cut.join(reputations(own, **how).select("host", "reputation"), "host", "left")
    return met.select(*(F.col(f"page.`{c}`").alias(c) for c in kept), "host", "path", "rule", F.coalesce("ruled", "reputation", F.lit("allow")).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql_kappa(of: str, n: str, b: str, parent: str) -> str:
    m, p = f"({parent})", f"({b} / {n})"
    sums = f"SELECT sum({n} * ({p} - {m}) * ({p} - {m})) AS spread, sum({m} * (1 - {m})) AS chance, sum(({n} - 1) * {m} * (1 - {m})) AS room FROM {of} WHERE {n} > 0"
    return f"(SELECT 1 / least({MOST_RHO}::DOUBLE, greatest({LEAST_RHO}::DOUBLE, (coalesce(spread, 0) - coalesce(chance, 0) + {PRIOR_RHO * PRIOR_ROOM}::DOUBLE) / (coalesce(room, 0) + {PRIOR_ROOM}::DOUBLE))) - 1 FROM ({sums}))"


_FITS = [f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1:]))]
_NAMES = [(what, h + p) for what, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1:]))]
ORACLE_OP3 = f"""
WITH cut AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
ruled AS (SELECT *, CASE {' '.join(f"{f} '{r}'" for f, (_, r) in zip(_FITS, _NAMES))} END AS rule, CASE {' '.join(f"{f} '{v}'" for f, (v, _) in zip(_FITS, _NAMES))} END AS ruled FROM cut),
h0 AS (SELECT host, count(ruled)::BIGINT AS n, count(*) FILTER (ruled = 'block')::BIGINT AS b, regexp_replace(regexp_replace(host, '{EXTRAS}', '', 'g'), '[.]+$', '') AS bare FROM ruled GROUP BY host),
h1 AS (SELECT *, regexp_extract(bare, '{patterns()[0]}', 1) AS two, regexp_extract(bare, '{patterns()[1]}', 1) AS tail, regexp_matches(bare, '{IP}') AS address FROM h0),
hosts AS (SELECT *, CASE WHEN address OR two = '' OR tail = bare THEN bare ELSE two END AS domain, CASE WHEN address THEN '{ADDRESS}' ELSE tail END AS sfx FROM h1),
domains AS (SELECT domain, sfx, sum(n)::BIGINT AS dn, sum(b)::BIGINT AS db FROM hosts GROUP BY ALL),
suffixes AS (SELECT sfx, sum(dn)::BIGINT AS sn, sum(db)::BIGINT AS sb FROM domains GROUP BY ALL),
g AS (SELECT coalesce(sum(sb) / nullif(sum(sn), 0), {UNSEEN})::DOUBLE AS rate FROM suffixes),
k AS (SELECT rate, {_sql_kappa('suffixes', 'sn', 'sb', '(SELECT rate FROM g)')} AS k1, {_sql_kappa('(SELECT * FROM domains JOIN suffixes USING (sfx))', 'dn', 'db', 'sb / sn')} AS k2, {_sql_kappa('(SELECT * FROM hosts JOIN domains USING (domain, sfx))', 'n', 'b', 'db / dn')} AS k3 FROM g),
p AS (SELECT host, n, k3, (b + k3 * (db + k2 * (sb + k1 * rate) / (sn + k1)) / (dn + k2)) / (n + k3) AS post FROM hosts JOIN domains USING (domain, sfx) JOIN suffixes USING (sfx), k)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN post - {Z}::DOUBLE * sqrt(post * (1 - post) / (n + k3 + 1)) > {MOST_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN p USING (host)
"""
