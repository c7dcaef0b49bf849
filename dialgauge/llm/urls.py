"""URL filters: rules by host and path, and block decisions that reach every alias of a page.

Aliases are pages joined by redirect edges (meta refresh) and canonical-link edges (rel=canonical, og:url), and URLs that
differ only in scheme, a www. or m. in front, fragment, tracking parameters, a closing slash or index page. Connected
components over the edges, computed on Spark, are the classes of aliases. A page that a rule fits keeps the rule's
verdict; any other takes its class's: allow if some alias is explicitly allowed, else block if some alias is blocked,
else allow.

Defined cases: a null URL, or one without ://, has empty host and path, fits no rule and has no alias: it is allowed;
repeated rows get the same verdict; an empty table gives no rows; columns other than id, URL and html are not looked
at; relative addresses are read against the page's host and path, with &amp; decoded and dots in paths resolved, others
than http(s) are no edges; a very long html is searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

# Verdict, host, start of the path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(?i)(^|&)(utm_[^&]*|ref=[^&]*|fbclid=[^&]*|gclid=[^&]*)"
_TAG = r"(?is)<(?:link|meta)\s[^>]*(?:rel\s*=\s*[\"']?canonical|property\s*=\s*[\"']?og:url|http-equiv\s*=\s*[\"']?refresh)[^>]*>"
_TARGET = r"(?is)\s(?:href\s*=\s*[\"']?\s*|content\s*=\s*[\"']?\s*(?:[0-9.]+\s*[;,]\s*url\s*=\s*['\"]?\s*)?)([^\"'\s>]+)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule = verdict = F.lit(None).cast("string")
    for name, domain, start in reversed(ordered):
        fits = ((host_col == domain) | F.endswith(host_col, F.lit(f".{domain}"))) & F.startswith(path_col, F.lit(start))
        rule = F.when(fits, F.lit(domain + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def alias_key(host_col: Column, path_col: Column, url: Column) -> Column:
    """What URLs have in common that differ only in spelling."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    plain_path = F.regexp_replace(F.regexp_replace(path_col, r"/index\.html?$", "/"), "/+$", "")
    plain = F.concat(F.regexp_replace(host_col, r"^(www|m)\.", ""), plain_path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))
    return F.when(host_col != "", F.xxhash64(plain))


def undotted(path_col: Column) -> Column:
    """A path with its . and .. segments taken out; it never goes above the root."""
    kept = F.aggregate(
        F.split(path_col, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.when(F.contains(path_col, F.lit("/.")), F.array_join(kept, "/")).otherwise(path_col)


def targets(html: Column, host_col: Column, path_col: Column) -> Column:
    """Addresses that a page names as its own or sends its readers to."""
    site = F.concat(F.lit("http://"), host_col)
    page, folder = F.when(path_col == "", "/").otherwise(path_col), F.regexp_extract(path_col, "^.*/", 0)
    folder = F.when(folder == "", "/").otherwise(folder)
    tags = F.when(
        F.lower(html).rlike("canonical|og:url|refresh"), F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))
    found = F.transform(tags, lambda tag: F.regexp_replace(F.regexp_extract(tag, _TARGET, 1), "(?i)&(amp|#38|#x26);", "&"))
    whole = F.transform(
        found,
        lambda t: F.when(t.startswith("//"), F.concat(F.lit("http:"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (t == ""), t)
        .when(t.rlike("^[?#]"), F.concat(site, page, t))
        .otherwise(F.concat(site, folder, t)),
    )
    return F.filter(whole, lambda t: t.rlike("(?i)^https?://"))


def judged(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(id, host, path, rule, verdict, alias): one row per input row; alias is the class's number (null: no URL)."""
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col).alias("id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select(
        "id", "host", "path", rule.alias("rule"), verdict.alias("own"),
        alias_key(F.col("host"), F.col("path"), F.col("url")).alias("node"), targets(F.col("html"), F.col("host"), F.col("path")).alias("targets"),
    )
    rows = written(rows, "pages")
    linked = rows.where("size(targets) > 0 and node is not null").select("node", F.explode("targets").alias("url"))
    linked = linked.select("node", host(F.col("url")).alias("host"), undotted(path(F.col("url"))).alias("path"), "url")
    linked = linked.select(
        "node", ruled(F.col("host"), F.col("path"), rules)[1].alias("own"), alias_key(F.col("host"), F.col("path"), F.col("url")).alias("to")
    )
    classes = connected_components(linked.select(F.col("node").alias("a"), F.col("to").alias("b")))
    decided = rows.select("node", "own").unionByName(linked.select(F.col("to").alias("node"), "own"))
    decided = decided.where("own is not null and node is not null").groupBy("node").agg(
        F.max((F.col("own") == "allow").cast("int")).alias("allowed")
    )
    nodes = rows.select("node").where("node is not null").distinct()
    classes = written(classes.select("node", F.col("component").alias("alias")), "classes")
    known = decided.join(classes, "node", "left").select(F.coalesce("alias", "node").alias("alias"), "allowed")
    verdicts = known.groupBy("alias").agg(F.max("allowed").alias("allowed"))
    nodes = nodes.join(classes, "node", "left").select("node", F.coalesce("alias", "node").alias("alias"))
    # One row per alias key: the pages' side of the last join is all that can be skewed, and Spark splits it.
    nodes = written(nodes.join(verdicts, "alias", "left"), "verdicts")
    said = F.coalesce("own", F.when(F.col("allowed") == 0, "block").otherwise("allow"))
    return rows.drop("targets").join(nodes, "node", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", said.alias("verdict"), "alias"
    )
