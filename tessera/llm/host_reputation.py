"""URL filter: rules first, then an empirical-Bayes reputation of hosts.

A page's outcome is known where its url's last number in the path is a labelled document: bad if its quality is 0 or
it is toxic. Outcomes are summed by host, registered domain (the suffix and the name before it) and suffix (the last name of a host, or
its last two where these are a public suffix such as co.uk; the list is a parameter). An IP address is its own domain and suffix; ports and
dots at the end are left out of both.
Each level's rate of bad pages is shrunk to that of the level above by a beta-binomial prior whose mean is the rate
above and whose weight is estimated from the spread of all rates at that level by the method of moments:
all pages -> suffix -> registered domain -> host. A host's posterior is a beta distribution; it is blocked if
the posterior's lower bound, mean - Z standard deviations, is over LIMIT.

A null url, or one without "://", has an empty host and path; the empty host has a reputation like any other.
Null labels count as no label, several labels of a document as one that is bad if any is. Extra columns are not read.
Hosts without labelled pages get the rate above them. Empty tables give no rows.

Only page_id, url and labels are read. Outcomes are summed before they are shuffled by host, so a hot host costs a row for
each task; the reputation of hosts is joined by broadcast only if it has few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path; the longest wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Public suffixes of two names, as registries publish them (fixed values).
SUFFIXES = tuple(
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk com.au edu.au gov.au id.au net.au org.au ac.nz co.nz govt.nz net.nz org.nz ac.jp ad.jp co.jp ed.jp go.jp gr.jp lg.jp ne.jp or.jp"
    " ac.kr co.kr go.kr or.kr com.br edu.br gov.br net.br org.br com.ar com.mx gob.mx com.co com.pe com.ve com.cn edu.cn gov.cn net.cn org.cn com.tw edu.tw org.tw com.hk org.hk com.sg edu.sg com.my co.id or.id"
    " co.th ac.th in.th com.ph com.vn co.in ac.in gov.in net.in org.in com.pk com.bd com.tr edu.tr gov.tr org.tr co.il ac.il org.il co.za ac.za org.za co.ke com.ng com.eg com.sa com.ua co.at or.at ac.at com.pl net.pl org.pl com.pt com.gr com.ru".split()
)
#: Rate of bad pages over which a host is blocked, and standard deviations between the mean and the bound (95 % one-sided).
LIMIT, Z = 0.25, 1.645
#: Least and greatest weight of a prior, in pages.
WEIGHT = (1.0, 1000.0)

#: A port and dots at the end of a host; IPv4 and IPv6 addresses.
_ENDS, _ADDRESS = r"\.*(:[0-9]*)?$", r"^([0-9]+(\.[0-9]+){3}|\[.*)$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST, _PATH, _DOC = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)", r"(?s)^.*/([0-9]{1,18})(?:[^0-9].*)?$"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _HOST, 1), _UPPER, _LOWER), F.regexp_extract(url, _PATH, 1)


def _longest_first(rules):
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that wins, as host + path, and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(_longest_first(rules)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _weight(rates: DataFrame, above: str) -> Column:
    """Pages that the prior of a level counts as: from n and bad of its members and the rate above them."""
    p = F.col(above)
    spread, within = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2)), F.sum(p * (1 - p))
    scale = F.sum((F.col("n") - 1) * p * (1 - p))
    share = F.when(scale > 0, (spread - within) / scale).otherwise(0.0)
    return F.least(F.greatest(F.when(share > 0, 1 / share - 1).otherwise(WEIGHT[1]), F.lit(WEIGHT[0])), F.lit(WEIGHT[1]))


def _shrink(rates: DataFrame, above: str, name: str) -> DataFrame:
    weight = rates.where("n > 0").agg(_weight(rates, above)).head()[0] or WEIGHT[1]
    return rates.withColumn("weight", F.lit(weight)).withColumn(name, (F.col("bad") + F.col("weight") * F.col(above)) / (F.col("n") + F.col("weight")))


def domains_of(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Suffix and registered domain."""
    bare = F.regexp_replace(host, _ENDS, "")
    names = F.split(bare, r"\.")
    last = lambda n: F.concat_ws(".", F.slice(names, F.greatest(F.size(names) - (n - 1), F.lit(1)), F.lit(n)))
    address, two = bare.rlike(_ADDRESS), last(2).isin(*suffixes)
    return F.when(address, bare).when(two, last(2)).otherwise(last(1)), F.when(address, bare).when(two, last(3)).otherwise(last(2))


def reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """Of (host, bad: 1, 0 or null): host, n, bad, mean, bound and blocked for each host."""
    suffix, domain = domains_of(F.col("host"), suffixes)
    hosts = shared.cut(
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"suffix": suffix, "domain": domain})
    )
    rate = hosts.agg((F.sum("bad") + 1) / (F.sum("n") + 2)).head()[0] or 0.5
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _shrink(hosts.groupBy("suffix").agg(*sums).withColumn("rate", F.lit(rate)), "rate", "suffix_rate").select("suffix", "suffix_rate")
    domains = _shrink(hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix"), "suffix_rate", "domain_rate").select("domain", "domain_rate")
    rates = _shrink(hosts.join(domains, "domain"), "domain_rate", "mean")
    bound = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1))
    return rates.select("host", "n", "bad", "mean", bound.alias("bound"), (bound > LIMIT).alias("blocked"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    doc = F.expr("try_cast(nullif(doc, '') as bigint)")
    seen = rows.withColumn("doc", F.regexp_extract("path", _DOC, 1)).withColumn("doc", doc)
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(bad.alias("bad"))
    hosts = shared.cut(reputation(seen.join(known, "doc", "left").select("host", "bad")).select("host", "blocked"))
    text, verdict = rule(F.col("host"), F.col("path"), rules)
    found = rows.join(shared.small(hosts), "host", "left")
    return found.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def oracle(rules=RULES) -> str:
    fits = [(v, h + p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for v, h, p in _longest_first(rules)]
    text = " ".join(f"WHEN {c} THEN '{t}'" for _, t, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for v, _, c in fits)

    bare = f"regexp_replace(host, '{_ENDS}', '')"
    two = ", ".join(f"'{x}'" for x in SUFFIXES)

    def shrink(members: str, above: str, name: str, key: str) -> str:
        return f"""SELECT *, (bad + weight * {above}) / (n + weight) AS {name} FROM {members} CROSS JOIN
  (SELECT least(greatest(CASE WHEN share > 0 THEN 1 / share - 1 ELSE {WEIGHT[1]} END, {WEIGHT[0]}), {WEIGHT[1]}) AS weight FROM
    (SELECT CASE WHEN sum((n - 1) * {above} * (1 - {above})) > 0 THEN
       (sum(n * pow(bad / n - {above}, 2)) - sum({above} * (1 - {above}))) / sum((n - 1) * {above} * (1 - {above})) ELSE 0 END AS share FROM {members} WHERE n > 0))"""

    return f"""
WITH rows AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_HOST}', 1), '{_UPPER}', '{_LOWER}') AS host,
              regexp_extract(coalesce(url, ''), '{_PATH}', 1) AS path FROM pages),
known AS (SELECT doc_id AS doc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
hosts AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, {bare} AS bare, string_split({bare}, '.') AS names
          FROM (SELECT host, TRY_CAST(regexp_extract(path, '{_DOC}', 1) AS BIGINT) AS doc FROM rows) LEFT JOIN known USING (doc) GROUP BY host),
h AS (SELECT host, n, bad,
      CASE WHEN regexp_matches(bare, '{_ADDRESS}') THEN bare WHEN array_to_string(names[-2:], '.') IN ({two}) THEN array_to_string(names[-2:], '.') ELSE names[-1] END AS suffix,
      CASE WHEN regexp_matches(bare, '{_ADDRESS}') THEN bare WHEN array_to_string(names[-2:], '.') IN ({two}) THEN array_to_string(names[-3:], '.') ELSE array_to_string(names[-2:], '.') END AS domain FROM hosts),
t AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS rate FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, rate FROM h CROSS JOIN t GROUP BY suffix, rate),
s AS ({shrink('s0', 'rate', 'suffix_rate', 'suffix')}),
d0 AS (SELECT domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad, suffix_rate FROM h JOIN s ON h.suffix = s.suffix GROUP BY domain, h.suffix, suffix_rate),
d AS ({shrink('d0', 'suffix_rate', 'domain_rate', 'domain')}),
r0 AS (SELECT host, h.n, h.bad, domain_rate FROM h JOIN d ON h.domain = d.domain),
r AS ({shrink('r0', 'domain_rate', 'mean', 'host')}),
v AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (n + weight + 1)) > {LIMIT} AS blocked FROM r)
SELECT page_id, rows.host AS host, path, CASE {text} END AS rule, CASE {verdict} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT rows.*, blocked FROM rows LEFT JOIN v USING (host)) AS rows"""
