"""URL filter whose decisions follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import held
from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not choose a page.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


#: Rules of the query (fixed values).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for NULL or without it."""
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column, spellings: bool = False) -> Column:
    """Key under which spellings of one address meet; NULL for what has no host.

    Scheme, case of the host, default port, fragment and a missing path do not count, as they never choose a page. With
    ``spellings`` neither do ``www.``, ``m.``, ``amp.``, tracking parameters, a last slash, ``index.html`` and ``.html``, and other
    parameters are sorted: customs of many sites, but no rule of the web.
    """
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    if spellings:
        host = F.regexp_replace(host, r"^(www|m|amp)\.", "")
        path = F.regexp_replace(F.regexp_replace(path, r"/(index\.html?)?$", ""), r"\.html?$", "")
        kept = F.array_sort(F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)")))
        query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, query))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty if the tag has none."""
    value = F.regexp_extract(tag, rf"(?is)(?<=[\s/\"']){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)", 1)
    return F.regexp_replace(value, r"^[\"']|[\"']$", "")


#: Named references in addresses (fixed values); the ampersand comes last, as its name may spell another.
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """Character references of HTML, by number or by one of the five names that markup itself needs."""
    numbers = F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,5}|[xX][0-9a-fA-F]{1,4});"))

    def replaced(whole: Column, number: Column) -> Column:
        code = F.when(F.lower(F.substring(number, 1, 1)) == "x", F.conv(F.substring(number, 2, 9), 16, 10)).otherwise(number)
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")
        return F.replace(whole, F.concat(F.lit("&#"), number, F.lit(";")), char)

    out = F.aggregate(numbers, text, replaced)
    for name, value in _NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def html_targets(html: Column) -> Column:
    """Addresses in canonical links and in refreshes of a page, as an array; relative ones as they stand.

    Attributes may stand in any order, quoted or not, ``rel`` may hold several words, and comments are passed over. A tag ends
    at the next angle bracket, so unclosed tags cost no more than others.
    """
    plain = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ")
    links = F.filter(
        F.regexp_extract_all(plain, F.lit(r"(?i)<link\b[^<>]*>"), F.lit(0)),
        lambda tag: F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical"),
    )
    metas = F.filter(
        F.regexp_extract_all(plain, F.lit(r"(?i)<meta\b[^<>]*>"), F.lit(0)),
        lambda tag: F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh",
    )
    refresh = lambda tag: F.regexp_extract(unescape(_attribute(tag, "content")), r"(?is)\burl\s*=\s*[\"']?([^\"']*)", 1)
    found = F.concat(F.transform(links, lambda tag: unescape(_attribute(tag, "href"))), F.transform(metas, refresh))
    trimmed = F.filter(F.transform(found, F.trim), lambda x: x != "")
    return F.when(html.rlike(r"(?i)canonical|http-equiv"), trimmed)


def html_base(html: Column) -> Column:
    """The address in a page's base element; empty without one."""
    tag = F.regexp_extract(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " "), r"(?i)<base\b[^<>]*>", 0)
    return F.when(html.rlike(r"(?i)<base\b"), F.trim(unescape(_attribute(tag, "href")))).otherwise(F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)

    def step(stack: Column, part: Column) -> Column:
        up = F.when(F.size(stack) > 1, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        return F.when(part == ".", stack).when(part == "..", up).otherwise(F.concat(stack, F.array(part)))

    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    # A last segment of dots names a folder.
    whole = F.when(last.isin(".", "..") & ~F.endswith(kept, F.lit("/")), F.concat(kept, F.lit("/"))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), whole).otherwise(path)


def resolve(base: Column, target: Column) -> Column:
    """A target made absolute by an address, as a browser would; NULL for an empty one."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*)://", 1)
    host = F.regexp_extract(_after_scheme(base), r"^[^/?#]*", 0)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(path_of(base), r"^(.*/)", 1)
    own = F.regexp_extract(target, r"^[^?#]*", 0)
    tail = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    return (
        F.when(target == "", None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, _without_dots(own), tail))
        .when(F.startswith(target, F.lit("?")), F.concat(root, path_of(base), target))
        .when(F.startswith(target, F.lit("#")), base)
        .otherwise(F.concat(root, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)), tail))
    )


def matched_rule(host: Column, path: Column, rules: Sequence[Rule], what) -> Column:
    """``what(rule)`` of the longest rule whose host is the page's or a parent of it and whose path begins the page's."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        own = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        out = out.when(own & F.startswith(path, F.lit(rule.path)), F.lit(what(rule)))
    return out


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    redirects: DataFrame | None = None,
    default: str = "allow",
    spellings: bool = False,
) -> DataFrame:
    """One row per page (page_id, url, html): page_id, host, path, rule, alias, verdict.

    A rule that fits decides its page. Other pages take the decision of their aliases: addresses with one canonical
    spelling (see ``canonical``), and those joined by canonical links, refreshes or ``redirects`` (src, dst), through any number of hops. If any
    alias is allowed by a rule they are allowed, else blocked if any is blocked, else ``default``. ``alias`` is the
    smallest canonical address of the component. Decisions are counted per address before components meet, so an
    address with very many pages or aliases is not gathered. ``rules`` is a short list; it becomes one expression.
    A NULL url, or one without ``://``, has empty host and path, no alias, and the default verdict; NULL html has no link;
    repeated pages are judged alike; an empty table gives no rows.
    """
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    rows = pages.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        matched_rule(host, path, rules, str).alias("rule"),
        matched_rule(host, path, rules, lambda r: r.verdict).alias("_own"),
        canonical(url, spellings).alias("_key"),
    )
    html = F.col("html")
    targets = pages.select("url", html_base(html).alias("_base"), F.explode(html_targets(html)).alias("_target"))
    # Step by step, each a column of its own: put into each other, these expressions would grow beyond use.
    targets = targets.withColumn("_base", held(resolve(url, F.col("_base"))))
    targets = targets.withColumn("_base", held(F.coalesce("_base", "url")))
    targets = targets.withColumn("_there", held(resolve(F.col("_base"), F.col("_target"))))
    edges = targets.select(canonical(url, spellings).alias("a"), canonical(F.col("_there"), spellings).alias("b"))
    if redirects is not None:
        ends = [canonical(F.col(c), spellings).alias(e) for c, e in (("src", "a"), ("dst", "b"))]
        edges = edges.unionByName(redirects.select(*ends))
    component = connected_components(edges.filter("a <> b")).select(F.col("node").alias("_key"), F.col("component").alias("_alias"))
    votes = (
        rows.filter("_own is not null and _key is not null")
        .groupBy("_key")
        .agg(F.max(F.col("_own") == "allow").alias("_allow"))
        .join(component, "_key", "left")
        .groupBy(F.coalesce("_alias", "_key").alias("_alias"))
        .agg(F.max("_allow").alias("_allow"))
    )
    placed = rows.join(component, "_key", "left").withColumn("_alias", F.coalesce("_alias", "_key"))
    method = F.when(F.col("_allow"), "allow").when(~F.col("_allow"), "block").otherwise(default)
    return placed.join(votes, "_alias", "left").select(
        "page_id", "host", "path", "rule", F.col("_alias").alias("alias"), F.coalesce("_own", method).alias("verdict")
    )
