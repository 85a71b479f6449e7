"""URL filtering by rules and by empirical-Bayes host reputation. DataFrame functions only.

Labelled pages give each host a count of outcomes and of bad ones. The share of
bad outcomes is shrunk through beta-binomial priors: a suffix towards the rate of
all outcomes, a registered domain towards its suffix, a host towards its domain.
The strength of each prior is fitted to the outcomes by moments. A page is
blocked if the lower posterior bound of its host's bad share exceeds a limit; a
rule that fits the page decides before that.

Hosts are counted by a combinable aggregate, so a hot host is summed up before
the shuffle; pages meet reputations in one join on the host, hot hosts by
broadcast. User info and port of a host are no part of its name, and an address
is its own domain and suffix.

Defined cases: a null url or one without :// has empty host and path, which no
rule fits and whose reputation is its own; outcomes of unknown pages are
ignored, a page with several outcomes counts once for each, repeated outcomes and
pages too; a url of any length is read whole; without outcomes
nothing is blocked by the method; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import Workspace, split_join

#: Labels that make a public suffix with a country's label of two letters behind them (`co.uk`, `com.cn`); other suffixes have one label.
SECOND_LABELS = "ac ad asn co com edu go gob gov govt gub id ind ltd mil ne net nhs nom or org plc police sch".split()
_TWO_LABELS = r"^(" + "|".join(SECOND_LABELS) + r")\.[a-z]{2}$"
#: Deviations below the posterior mean that the bound lies, the limit it must exceed, and the prior strengths allowed.
DEVIATIONS, LIMIT, WEAKEST, STRONGEST = 1.645, 0.5, 2.0, 200.0

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def bare(host: Column) -> Column:
    """A host without user info and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9.]+|\[.*)$")


def suffix_of(host: Column) -> Column:
    """The public suffix of a host name; an address is one of its own."""
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.rlike(_TWO_LABELS), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The label before the suffix, with the suffix; an address is one of its own."""
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.rlike(_TWO_LABELS), F.substring_index(name, ".", -3)).otherwise(two)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    own = (host == rule[1]) | host.endswith("." + rule[1])
    return own & path.startswith(rule[2])


def _strength(level: DataFrame, mean: str) -> DataFrame:
    """Beta-binomial strength of the groups (n, bad, mean of their prior), by moments: 1/intra-group correlation - 1."""
    p = F.col(mean)
    spread = F.sum((F.col("bad") - F.col("n") * p) ** 2)
    single = F.sum(F.col("n") * p * (1 - p))
    extra = F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p))
    rho = (spread - single) / extra
    fitted = F.when((extra > 0) & (rho > 0), 1 / rho - 1).otherwise(STRONGEST)
    return level.agg(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.round(fitted, 6))).alias("strength"))


def _shrunk(level: DataFrame, mean: str, name: str) -> DataFrame:
    """`level` with its posterior mean `name`, and its weight."""
    fitted = level.crossJoin(F.broadcast(_strength(level, mean)))  # one row
    return fitted.withColumn(name, F.round((F.col("bad") + F.col("strength") * F.col(mean)) / (F.col("n") + F.col("strength")), 9)).withColumn(
        "weight", F.col("n") + F.col("strength")
    ).drop("strength")


def reputation(outcomes: DataFrame) -> DataFrame:
    """From (host, bad) the posterior of each host: host, n, bad, mean, bound."""
    known = outcomes.filter("bad is not null")
    hosts = known.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    all_ = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("base"))
    suffixes = _shrunk(suffixes.crossJoin(F.broadcast(all_)), "base", "suffix_mean").select("suffix", "suffix_mean")
    domains = _shrunk(domains.join(suffixes, "suffix"), "suffix_mean", "domain_mean").select("domain", "domain_mean")
    hosts = _shrunk(hosts.join(domains, "domain"), "domain_mean", "mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return hosts.select("host", "n", "bad", "mean", F.round(F.col("mean") - DEVIATIONS * deviation, 9).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, host_outcomes, host_bad) of every page; `outcomes` has page_id and bad (0/1)."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labelled = outcomes.select("page_id", "bad").join(rows.select("page_id", "host"), "page_id").select("host", "bad")
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = _fits((verdict, host, path), F.col("host"), F.col("path"))
        rule, decided = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(decided)
    # reputations are written: a host with outcomes is a row, told by how many pages it has
    pages_of = rows.groupBy("host").agg(F.count("*").alias("n_rows"))
    known = Workspace(pages.sparkSession).put(reputation(labelled).join(pages_of, "host"))
    found = split_join(rows, known, ["host"], pages.count(), "left")
    own = F.when(F.col("bound") > LIMIT, "block").otherwise("allow")
    return found.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(decided, own).alias("verdict"),
        F.coalesce("n", F.lit(0)).cast("long").alias("host_outcomes"),
        F.coalesce("bad", F.lit(0)).cast("long").alias("host_bad"),
    )


def oracle_sql(rules: list[Rule]) -> str:
    """The same for DuckDB, over pages and labels."""
    two = f"regexp_matches(array_to_string(list_slice(string_split(name, '.'), -2, -1), '.'), '{_TWO_LABELS}')"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    tail = lambda n: f"array_to_string(list_slice(string_split(name, '.'), -{n}, -1), '.')"
    own = r"regexp_matches(name, '^([0-9.]+|\[.*)$')"

    def shrunk(source: str, mean: str, name: str) -> str:
        rho = f"(sum((bad - n * {mean}) ** 2) - sum(n * {mean} * (1 - {mean}))) / sum(n * (n - 1) * {mean} * (1 - {mean}))"
        fit = f"CASE WHEN sum(n * (n - 1) * {mean} * (1 - {mean})) > 0 AND {rho} > 0 THEN 1 / ({rho}) - 1 ELSE {STRONGEST} END"
        return (
            f"SELECT s.*, round((bad + strength * {mean}) / (n + strength), 9) AS {name}, n + strength AS weight FROM {source} s, "
            f"(SELECT greatest({WEAKEST}, least({STRONGEST}, round({fit}, 6))) AS strength FROM {source})"
        )

    return f"""
WITH rows AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts0 AS (
  SELECT host, count(*) AS n, CAST(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS bad
  FROM labels JOIN rows ON doc_id = page_id WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY host),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM hosts0),
hosts1 AS (SELECT * EXCLUDE (name), CASE WHEN {own} THEN name WHEN {two} THEN {tail(3)} ELSE {tail(2)} END AS domain,
                  CASE WHEN {own} THEN name WHEN {two} THEN {tail(2)} ELSE {tail(1)} END AS suffix FROM named),
domains0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts1 GROUP BY ALL),
suffixes0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains0 GROUP BY ALL),
suffixes1 AS (SELECT suffix, n, bad, (sum(bad) OVER () + 1) / (sum(n) OVER () + 2) AS base FROM suffixes0),
suffixes AS ({shrunk("suffixes1", "base", "suffix_mean")}),
domains1 AS (SELECT d.*, suffix_mean FROM domains0 d JOIN suffixes USING (suffix)),
domains AS ({shrunk("domains1", "suffix_mean", "domain_mean")}),
hosts2 AS (SELECT h.*, domain_mean FROM hosts1 h JOIN domains USING (domain)),
hosts AS ({shrunk("hosts2", "domain_mean", "mean")})
SELECT page_id, r.host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN round(mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (weight + 1)), 9) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(n, 0) AS host_outcomes, CAST(coalesce(bad, 0) AS BIGINT) AS host_bad
FROM rows r LEFT JOIN (SELECT host AS h, n, bad, mean, weight FROM hosts) ON r.host = h""".replace("(host = ", "(r.host = ").replace("ends_with(host,", "ends_with(r.host,")
