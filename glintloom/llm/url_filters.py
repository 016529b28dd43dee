"""URL filters by host reputation with empirical-Bayes priors (operator 2).

Of labelled pages the bad and all outcomes are counted for each host, registered domain
and suffix. Rates are shrunk from the top: a suffix towards all pages, a domain towards
its suffix, a host towards its domain. How strongly is estimated at each level from the
spread of the observed rates (method of moments for the beta-binomial). The posterior of
a host is a beta distribution; a page is blocked if the lower bound of its bad rate, the
mean less Z standard deviations, exceeds MAX_BAD. Explicit rules go before.

Only DataFrame functions are used. The counts of hosts, domains and suffixes are made
before rows are moved, so a host with a third of all pages needs no care; looking them
up is a broadcast for counted small tables, else a salted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintloom.llm.common import ascii_lower, join_sized, materialise

Z = 1.645
MAX_BAD = 0.4
#: Limits of the estimated strength of a prior, in pages.
STRENGTH = (1.0, 1000.0)
#: Second-level labels below which names are registered under two-letter suffixes, and shared names whose parts belong to others.
SECOND_LEVEL = tuple("ac art asn biz co com edu firm gen go gob gouv gov govt gv id in info ltd me mil mod muni ne net nhs nom ny or org plc pp re res sch tm web".split())
SHARED_NAMES = tuple("appspot.com azurewebsites.net blogspot.com firebaseapp.com github.io gitlab.io herokuapp.com netlify.app pages.dev tumblr.com vercel.app web.app wordpress.com workers.dev".split())
_ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\["
LEVELS = ("suffix", "domain", "host")


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What stands between the host and the next ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _names(host: Column) -> dict[str, Column]:
    """The levels of a host: without user and port, its registered domain and its suffix. An IP address is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    address = name.rlike(_ADDRESS)
    labels = F.split(name, r"\.")
    size = F.size(labels)
    last = lambda n: F.substring_index(name, ".", -n)
    two = (size >= 3) & (((F.length(F.get(labels, size - 1)) == 2) & F.get(labels, size - 2).isin(*SECOND_LEVEL)) | last(2).isin(*SHARED_NAMES))
    return {"host": name, "domain": F.when(address, name).when(two, last(3)).otherwise(last(2)), "suffix": F.when(address, name).when(two, last(2)).otherwise(last(1))}


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Verdict and text of the longest rule that fits, else null. Rules are (verdict, "host/path"), a parameter of a few dozen."""
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/") if "/" in rule else len(rule)
        name, start = rule[:at].lower(), rule[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(best)
    return best["verdict"], best["rule"]


def _strength(rates: DataFrame) -> float:
    """Strength of the beta prior around `mean` for observed `bad` of `n`: from the part of their spread that binomial noise leaves over."""
    v = F.col("mean") * (1 - F.col("mean"))
    total = F.sum("n")
    row = rates.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2)).alias("s"), F.sum(v).alias("noise"), F.sum(v * F.col("n")).alias("most"), total.alias("n")
    ).first()
    if not row["n"] or row["most"] <= row["noise"]:
        return STRENGTH[1]
    rho = (row["s"] - row["noise"]) / (row["most"] - row["noise"])
    return STRENGTH[1] if rho <= 0 else min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1])


class Reputation:
    """Shrunk bad rates of suffixes, domains and hosts. labelled has url and bad (boolean); rows with a null are left out."""

    def __init__(self, labelled: DataFrame) -> None:
        names = _names(url_host(F.col("url")))
        seen = labelled.where("url IS NOT NULL AND bad IS NOT NULL").select(F.col("bad").cast("long").alias("bad"), *[c.alias(k) for k, c in names.items()])
        hosts = materialise(seen.groupBy(*LEVELS).agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
        whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
        #: Mean of all pages; with one good and one bad page added, so that it is never 0 or 1.
        self.mean = (whole["bad"] + 1) / (whole["n"] + 2)
        self.strengths: dict[str, float] = {}
        self.levels: dict[str, DataFrame] = {}
        for k, level in enumerate(LEVELS):
            counts = hosts.groupBy(*LEVELS[: k + 1]).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
            if k == 0:
                counts = counts.withColumn("mean", F.lit(self.mean))
            else:
                above = self.levels[LEVELS[k - 1]].select(LEVELS[k - 1], F.col("rate").alias("mean"))
                counts = join_sized(counts, above, [LEVELS[k - 1]], "inner", salts=16)
            counts = materialise(counts)
            self.strengths[level] = s = _strength(counts)
            rate = (F.col("bad") + F.col("mean") * s) / (F.col("n") + s)
            self.levels[level] = materialise(counts.select(level, "n", "bad", "mean", rate.alias("rate")))

    def with_bound(self, rows: DataFrame, host: str = "host") -> DataFrame:
        """rows with bad_bound: the lower bound of the bad rate of each row's host. Hosts without labels take their domain's rate as prior, and so on."""
        names = _names(F.col(host))
        out = rows.select("*", *[names[level].alias(f"__{level}") for level in LEVELS])
        for level in LEVELS:
            own = self.levels[level].select(F.col(level).alias(f"__{level}"), F.col("rate").alias(f"__{level}_rate"), *([F.col("n").alias("__n"), F.col("bad").alias("__bad")] if level == "host" else []))
            out = join_sized(out, own, [f"__{level}"], "left", salts=16)
        prior = F.coalesce("__domain_rate", "__suffix_rate", F.lit(self.mean))
        # a prior from farther up is as loose as the loosest level between
        host, domain, suffix = (self.strengths[level] for level in ("host", "domain", "suffix"))
        s = F.when(F.col("__domain_rate").isNotNull(), F.lit(host)).when(F.col("__suffix_rate").isNotNull(), F.lit(min(host, domain))).otherwise(F.lit(min(host, domain, suffix)))
        a = F.coalesce("__bad", F.lit(0)) + prior * s
        total = F.coalesce("__n", F.lit(0)) + s
        mean = a / total
        bound = mean - F.lit(Z) * F.sqrt(mean * (1 - mean) / (total + 1))
        return out.select(*rows.columns, F.greatest(bound, F.lit(0.0)).alias("bad_bound"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """pages with host, path, rule, bad_bound and verdict ("allow" or "block"), in place of columns of these names.

    The longest fitting rule decides; without one, a page is blocked if the lower bound
    of its host's bad rate exceeds MAX_BAD. Null urls and urls without :// have an empty
    host and path, fit no rule and take the rate of all pages. Without labels nothing is
    blocked but by rule. Repeated rows are judged alike; an empty table stays empty.
    """
    names = ("host", "path", "rule", "bad_bound", "verdict")
    kept = [c for c in pages.columns if c.lower() not in names]
    rows = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    bounded = Reputation(labelled).with_bound(rows)
    verdict, rule = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > MAX_BAD, "block").otherwise("allow")
    return bounded.select(*kept, "host", "path", rule.alias("rule"), "bad_bound", F.coalesce(verdict, own).alias("verdict"))


def allowed_pages(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The rows of pages that are not blocked, columns as before.

    Rows with a null url or one without a host fall to the method's verdict on the empty
    host; repeated rows all stay or all go. Columns that clash with those of judge_urls
    come back as they were; an empty table stays empty.
    """
    judged = judge_urls(pages.select("*", F.struct("*").alias("__row")), labelled, rules)
    return judged.where("verdict = 'allow'").select("__row.*")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages that are labelled: bad if a label of the same id calls it toxic or of low quality."""
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    return pages.select("page_id", "url").join(bad, "page_id").select("url", "bad")


def oracle(rules: list[tuple[str, str]]) -> str:
    """DuckDB SQL for the columns that the query op2 returns."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = f"coalesce({lower.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '')"
    second, shared = (", ".join(f"'{x}'" for x in names) for names in (SECOND_LEVEL, SHARED_NAMES))

    def tail(n: int) -> str:
        return f"array_to_string(list_slice(l, greatest(len(l) - {n - 1}, 1), len(l)), '.')"

    def rule(text: str) -> str:
        name, _, rest = text.partition("/")
        return f"((host = '{name}' OR suffix(host, '.{name}')) AND prefix(path, '/{rest}'))"

    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    verdicts = " ".join(f"WHEN {rule(t)} THEN '{v}'" for v, t in order)
    texts = " ".join(f"WHEN {rule(t)} THEN '{t}'" for v, t in order)

    def level(k: int, name: str, above: str | None) -> str:
        mean = "(SELECT mean FROM whole)" if above is None else "a.rate"
        join = "" if above is None else f"JOIN {above}_r a ON a.{above} = c.{above}"
        return f"""
    {name}_c AS (SELECT c.{name}, c.n, c.bad, {mean} AS mean FROM (SELECT {', '.join(LEVELS[: k + 1])}, count(*) AS n, sum(bad) AS bad FROM seen GROUP BY ALL) c {join}),
    {name}_m AS (SELECT sum(n * pow(bad / n - mean, 2)) AS s, sum(mean * (1 - mean)) AS noise, sum(mean * (1 - mean) * n) AS most FROM {name}_c),
    {name}_s AS (SELECT CASE WHEN s IS NULL OR most <= noise OR s <= noise THEN {STRENGTH[1]}::DOUBLE ELSE least(greatest((most - noise) / (s - noise) - 1, {STRENGTH[0]}), {STRENGTH[1]}) END AS st FROM {name}_m),
    {name}_r AS (SELECT {name}, n, bad, (bad + mean * st) / (n + st) AS rate FROM {name}_c, {name}_s),"""

    return f"""
    WITH parts AS (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, url FROM pages),
    labels1 AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM parts),
    named AS (SELECT * EXCLUDE (l), array_to_string(l, '.') AS h, len(l) >= 3 AND ((length(l[-1]) = 2 AND l[-2] IN ({second})) OR {tail(2)} IN ({shared})) AS two, regexp_matches(array_to_string(l, '.'), '{_ADDRESS}') AS ip, {tail(1)} AS t1, {tail(2)} AS t2, {tail(3)} AS t3 FROM labels1),
    page AS (SELECT page_id, url, host AS raw_host, path, h AS host, CASE WHEN ip THEN h WHEN two THEN t3 ELSE t2 END AS domain, CASE WHEN ip THEN h WHEN two THEN t2 ELSE t1 END AS suffix FROM named),
    outcome AS (SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
    seen AS (SELECT suffix, domain, host, bad::DOUBLE AS bad FROM page JOIN outcome ON doc_id = page_id WHERE url IS NOT NULL),
    whole AS (SELECT (coalesce(sum(bad), 0) + 1) / (count(*) + 2)::DOUBLE AS mean FROM seen),
    {level(0, "suffix", None).strip()}{level(1, "domain", "suffix")}{level(2, "host", "domain")}
    st AS (SELECT h.st AS sh, least(h.st, d.st) AS sd, least(h.st, d.st, s.st) AS ss FROM host_s h, domain_s d, suffix_s s),
    prior AS (SELECT p.*, r.n, r.bad, coalesce(d.rate, s.rate, mean) AS rate, CASE WHEN d.rate IS NOT NULL THEN sh WHEN s.rate IS NOT NULL THEN sd ELSE ss END AS st
      FROM page p LEFT JOIN host_r r ON r.host = p.host LEFT JOIN domain_r d ON d.domain = p.domain LEFT JOIN suffix_r s ON s.suffix = p.suffix, whole, st),
    post AS (SELECT *, (coalesce(bad, 0) + rate * st) / (coalesce(n, 0) + st) AS m, coalesce(n, 0) + st AS total FROM prior),
    bound AS (SELECT page_id, raw_host AS host, path, greatest(m - {Z} * sqrt(m * (1 - m) / (total + 1)), 0) AS bad_bound FROM post)
    SELECT page_id, host, path, CASE {texts} END AS rule, round(bad_bound, 6) AS bad_bound, coalesce(CASE {verdicts} END, CASE WHEN bad_bound > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict FROM bound"""
