"""URL filters: host and path rules, and a host reputation by empirical Bayes.

Labelled page outcomes are counted for hosts, registered domains and suffixes. A level's beta prior has the parent's
posterior mean and a strength estimated by moments from the spread of its own members (beta-binomial). A host without a
rule is blocked if the lower bound of its posterior share of bad pages passes a limit. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import saved, spread_join
from colloquy.llm.exact import normalised

#: Suffixes of two labels under which domains are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.cn", "co.in", "co.kr", "com.mx", "co.za")
WEAKEST, STRONGEST = 2.0, 1000.0


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty if it is null or has no ://."""
    url = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return normalised(host), F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    host, path = host_and_path(url_col)
    return pages.withColumns({"host": host, "path": path})


def rule_of(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest of the rules (like example.net/en/) that fits, or null. Rules travel inside the expression: use a table for long lists."""
    ordered = sorted(rules, key=lambda r: (-len(r), r))
    known = F.array(*[F.struct(F.lit(r.partition("/")[0]).alias("h"), F.lit("/" + r.partition("/")[2]).alias("p"), F.lit(r).alias("r")) for r in ordered])
    fits = F.filter(known, lambda x: ((host == x["h"]) | F.endswith(host, F.concat(F.lit("."), x["h"]))) & F.startswith(path, x["p"]))
    return F.get(fits, 0)["r"]


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for every host that some rules of a table (rule, verdict) may fit, these, longest first."""
    parted = rules.where("rule is not null").select(F.substring_index("rule", "/", 1).alias("tail"), F.struct((-F.char_length("rule")).alias("n"), F.col("rule").alias("r"), F.expr("substr(rule, instr(rule, '/'))").alias("p"), F.col("verdict").alias("v")).alias("known"))
    return _tails(hosts.select("host").distinct()).join(parted, "tail").groupBy("host").agg(F.array_sort(F.collect_list("known")).alias("rules"))


def _tails(hosts: DataFrame) -> DataFrame:
    """(host, tail) for a host and the ends of it that begin after a dot."""
    labels = F.size(F.split("host", r"\."))
    return hosts.select("host", F.explode(F.sequence(F.lit(1), labels)).alias("k")).select("host", F.expr("substring_index(host, '.', -k)").alias("tail"), "k")


def _bare(host: Column) -> Column:
    """The host without a user, a port and a last dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts with domain (registered) and suffix. An address in figures is its own domain, under the suffix `ip`.

    suffixes: a table (suffix) of those under which domains are registered, of any number of labels; without one, those
    of LONG_SUFFIXES and every last label. The longest that fits counts.
    """
    bare = _bare(F.col("host"))
    last = lambda n: F.substring_index(bare, ".", -n)
    is_ip = F.regexp_like(bare, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")) | F.startswith(bare, F.lit("["))
    if suffixes is None:
        is_long = last(2).isin(*LONG_SUFFIXES)
        domain, suffix = F.when(is_long, last(3)).otherwise(last(2)), F.when(is_long, last(2)).otherwise(last(1))
    else:
        fits = _tails(hosts.select(bare.alias("host")).distinct()).join(suffixes.select(F.col("suffix").alias("tail")).distinct(), "tail")
        longest = fits.groupBy(F.col("host").alias("_bare")).agg(F.max("k").cast("int").alias("_k"))
        hosts = hosts.join(longest, bare == F.col("_bare"), "left").withColumn("_k", F.coalesce("_k", F.lit(1))).drop("_bare")
        domain, suffix = F.call_function("substring_index", bare, F.lit("."), -(F.col("_k") + 1)), F.call_function("substring_index", bare, F.lit("."), -F.col("_k"))
    out = hosts.withColumns({"domain": F.when(is_ip, bare).otherwise(domain), "suffix": F.when(is_ip, F.lit("ip")).otherwise(suffix)})
    return out if suffixes is None else out.drop("_k")


def lower_bound(mean: Column, size: Column, z: float) -> Column:
    """The point that a beta variable of this mean and size (sum of its parameters) lies above with the probability that z stands for.

    By the cube-root normal approximation of the F distribution, solved for its quantile.
    """
    a, b = mean * size, (1 - mean) * size
    p, q, u, v = 1 - 1 / (9 * b), 1 - 1 / (9 * a), 1 / (9 * b), 1 / (9 * a)
    root = F.greatest(F.lit(0.0), p * p * q * q - (p * p - z * z * u) * (q * q - z * z * v))
    y = F.greatest(F.lit(0.0), (p * q - F.sqrt(root)) / (p * p - z * z * u))
    f = a * y * y * y
    return f / (b + f)


def _strength(members: DataFrame) -> Column:
    """Sum of the beta prior's parameters by moments, for members with n labelled pages of which y bad; weakest without any."""
    n, y = F.col("n"), F.col("y")
    total, p = F.sum(n), F.sum(y) / F.sum(n)
    spread = F.sum(y * y / n) - F.sum(y) * F.sum(y) / F.sum(n)
    k = F.count("*") - 1
    rho = (spread - p * (1 - p) * k) / F.nullif(p * (1 - p) * (total - F.sum(n * n) / total - k), F.lit(0.0))
    return F.when(total.isNull(), WEAKEST).when(rho <= 1 / (1 + STRONGEST), STRONGEST).when(rho >= 1 / (1 + WEAKEST), WEAKEST).otherwise(F.coalesce(1 / rho - 1, F.lit(STRONGEST)))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.6448536269514722, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n_labelled, n_bad, prior, mean, lower) for every host of pages.

    pages has page_id and host, outcomes page_id and bad (boolean). Repeated outcomes of a page count once, bad if any is.
    """
    marks = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.select("page_id", "host").join(marks, "page_id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.count_if("bad").cast("double").alias("y"))
    hosts = saved(with_domains(hosts, suffixes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    strength = {name: level.where("n > 0").agg(_strength(level).alias("k")).first()["k"] for name, level in (("host", hosts), ("domain", domains), ("suffix", suffixes))}
    n, y = suffixes.agg(F.sum("n"), F.sum("y")).first()
    overall = ((y or 0.0) + 1) / ((n or 0.0) + 2)
    shrunk = lambda prior, k: (F.col("y") + prior * k) / (F.col("n") + k)
    suffixes = suffixes.select("suffix", shrunk(F.lit(overall), strength["suffix"]).alias("_s"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("_s"), strength["domain"]).alias("prior"))
    k = strength["host"]
    out = hosts.join(domains, "domain").withColumn("mean", shrunk(F.col("prior"), k))
    return out.select("host", F.col("n").cast("long").alias("n_labelled"), F.col("y").cast("long").alias("n_bad"), "prior", "mean", lower_bound(F.col("mean"), F.col("n") + k, z).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str] | DataFrame, limit: float = 0.25, url_col: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior lower bound, one row per row of pages.

    rules: host/path -> allow or block, or for long lists a table (rule, verdict). A url that a rule fits gets its
    verdict, the longest rule winning; any other is blocked if its host's lower bound is above limit. A null url, or one
    without ://, has an empty host and path and is judged as a page of the empty host. Rows with null or repeated ids each
    give a row, and a page counts once for its host for every row; urls may be of any length; other columns take no part;
    an empty table gives no rows. Hosts with very many pages are dealt over many tasks.
    """
    own = with_host(pages.select("page_id", F.col(url_col).alias("url")), "url")
    bounds = host_reputation(own, outcomes, suffixes=suffixes).select("host", "lower")
    bounds = saved(bounds.join(own.groupBy("host").agg(F.count("*").alias("_pages")), "host"), "bounds")
    listed = isinstance(rules, DataFrame)
    if listed:
        bounds = saved(bounds.join(rules_of_hosts(bounds, rules), "host", "left"), "rules")
    out = spread_join(own, bounds, ["host"], "page_id", "_pages")
    method = F.when(F.col("lower") > limit, "block").otherwise("allow")
    if listed:
        fits = F.get(F.filter("rules", lambda x: F.startswith(F.col("path"), x["p"])), 0)
        rule, verdict = fits["r"], F.coalesce(fits["v"], method)
    elif rules:
        rule = rule_of(rules, F.col("host"), F.col("path"))
        verdict = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), rule), method)
    else:
        rule, verdict = F.lit(None).cast("string"), method
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.round("lower", 6).alias("lower"))
