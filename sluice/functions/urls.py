"""Column functions on URLs. Texts that are no URL give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and names by which URLs are classified.
DETAIL_PATH = r"(?i)(/dp/[A-Z0-9]{10}\b|/gp/product/|/detail/|/product/|/products/|/p/|\.html$)"
STATIC_ASSET = r"\.(?:js|css|png|jpe?g|gif|webp|svg|ico|woff2?|ttf|map)$"
PRODUCT_TARGET = r"(\.html$|/p/|/product/|/products/|sku=|pid=)"
CONTENT_TARGET = r"(/blog/|/news/|/article/|/magazine/|/inspiration/|/advies/)"
PROMOTION_TARGET = r"(/sale|/deals|/offers|/aanbiedingen|/actie)"
PRODUCT_URL = r"(?i)(\.html$|/producten/|/product/|/p/|pid=|sku=)"
PAGINATION_NAMES = ("page", "p", "offset", "limit", "cursor", "start", "from", "size", "sort", "filter", "node")
NOT_PAGINATION_NAMES = ("pagetype", "currentpagetype", "currentsubpagetype", "hostpagetype", "hostsubpagetype")
STRONG_PAGINATION_NAMES = ("page", "p", "offset", "cursor", "start", "from")
PAGINATION_PART = r"(page|offset|limit|cursor|sort|filter|node)"


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(F.trim(url), F.lit(name))


def authority(url: Column) -> Column:
    """Host with port and user, in lower case."""
    return F.lower(part(url, "AUTHORITY"))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def path(url: Column) -> Column:
    """Path without parameters behind a semicolon in its last segment."""
    return F.regexp_replace(part(url, "PATH"), ";[^/]*$", "")


def query(url: Column) -> Column:
    return F.coalesce(part(url, "QUERY"), F.lit(""))


# URLs that are their own canonical form, told by one pattern: parsing takes each part anew.
CANONICAL = r"\Ahttps?://[a-z0-9-]+(?:\.[a-z0-9-]+)*/[A-Za-z0-9/._~-]*(?:\?[A-Za-z0-9=&._~-]+)?\z"


def canonical_url(url: Column) -> Column:
    """Scheme and authority in lower case, path or /, query; no fragment. Null unless http or https with a host."""
    scheme = F.lower(part(url, "PROTOCOL"))
    where = F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/"))
    whole = F.concat(scheme, F.lit("://"), authority(url), where, F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit("")))
    return F.when(url.rlike(CANONICAL), url).when(scheme.isin("http", "https") & (F.coalesce(authority(url), F.lit("")) != ""), whole)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def extension(url: Column) -> Column:
    """Extension of the last path segment in lower case, '' without one."""
    return F.regexp_extract(F.lower(F.coalesce(path(url), F.lit(""))), r"\.([^./]+)$", 1)


def query_params(url: Column) -> Column:
    """Map of decoded query parameters; of a name given twice the last counts (spark.sql.mapKeyDedupPolicy LAST_WIN)."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: F.contains(p, F.lit("=")) | (p != ""))
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    entries = F.transform(pairs, lambda p: F.struct(decode(F.substring_index(p, "=", 1)), F.when(F.contains(p, F.lit("=")), decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit(""))))
    return F.map_from_entries(entries)


def pagination_params(url: Column) -> Column:
    """Map of the query parameters whose names are those of paging, sorting or filtering."""
    name = lambda k: F.lower(k)
    return F.map_filter(query_params(url), lambda k, v: ~name(k).isin(*NOT_PAGINATION_NAMES) & (name(k).isin(*PAGINATION_NAMES) | name(k).rlike(PAGINATION_PART)))


def has_strong_pagination(params: Column) -> Column:
    return F.exists(F.map_keys(params), lambda k: F.lower(k).isin(*STRONG_PAGINATION_NAMES))


def same_site(url: Column, base: Column) -> Column:
    return F.coalesce(authority(url), F.lit("")).isin("") | F.coalesce(authority(url) == authority(base), F.lit(False))


def looks_like_detail(url: Column) -> Column:
    return F.coalesce(path(url), F.lit("")).rlike(DETAIL_PATH)


def is_json_like(url: Column) -> Column:
    p = F.lower(F.coalesce(path(url), F.lit("")))
    return p.endswith(".json") | p.endswith(".graphql") | p.contains("/graphql") | p.contains("/api/")


def is_static_asset(url: Column) -> Column:
    return F.lower(F.coalesce(path(url), F.lit(""))).rlike(STATIC_ASSET)


def classify_url(url: Column, base: Column | None = None) -> Column:
    """missing, contact, external, product, content, promotion or category."""
    target = F.concat(F.lower(F.coalesce(path(url), F.lit(""))), F.when(query(url) != "", F.concat(F.lit("?"), F.lower(query(url)))).otherwise(F.lit("")))
    out = F.when(F.coalesce(url, F.lit("")) == "", F.lit("missing")).when(F.lower(url).rlike("^(mailto|tel):"), F.lit("contact"))
    if base is not None:
        out = out.when(F.coalesce(part(url, "AUTHORITY") != part(base, "AUTHORITY"), F.lit(False)), F.lit("external"))
    return out.when(target.rlike(PRODUCT_TARGET), F.lit("product")).when(target.rlike(CONTENT_TARGET), F.lit("content")).when(target.rlike(PROMOTION_TARGET), F.lit("promotion")).otherwise(F.lit("category"))


def host_suffixes(name: Column) -> Column:
    """The host and all its parent domains: a.b.c, b.c, c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def domain_matches(name: Column, patterns: list[str]) -> Column:
    """The host is one of the patterns or below one of them."""
    found = F.lit(False)
    for p in (x.strip().lower().lstrip(".") for x in patterns):
        if p:
            found = found | (name == p) | name.endswith("." + p)
    return F.coalesce(found, F.lit(False))


def path_parts(url: Column) -> Column:
    """Decoded non-empty segments of the path; a + stays one."""
    parts = F.filter(F.split(F.coalesce(path(url), F.lit("")), "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))


def prefixes(parts: Column, most: Column | int | None = None) -> Column:
    """All prefixes of an array, shortest first, up to most elements."""
    top = F.size(parts) if most is None else F.least(F.size(parts), F.lit(most) if isinstance(most, int) else most)
    return F.when(top >= 1, F.transform(F.sequence(F.lit(1), top), lambda d: F.slice(parts, F.lit(1), d))).otherwise(F.array().cast("array<array<string>>"))


def url_allowed(url: Column, *, schemes: tuple[str, ...] = ("http", "https", "file"), allow: tuple[str, ...] = (), deny: tuple[str, ...] = (), allow_domains: tuple[str, ...] = (), deny_domains: tuple[str, ...] = (), deny_extensions: tuple[str, ...] = ()) -> Column:
    """Link rules: scheme, extension, patterns (any allowed, none denied) and domains (a denied one wins)."""
    scheme = F.when(url.rlike(CANONICAL), F.substring_index(url, "://", 1)).otherwise(F.lower(part(url, "PROTOCOL")))
    ok = F.coalesce(scheme.isin(*schemes), F.lit(False))
    if deny_extensions:
        ok = ok & ~extension(url).isin(*deny_extensions)
    if allow:
        ok = ok & url.rlike("|".join(f"(?:{p})" for p in allow))
    if deny:
        ok = ok & ~url.rlike("|".join(f"(?:{p})" for p in deny))
    if deny_domains:
        ok = ok & ~domain_matches(host(url), list(deny_domains))
    if allow_domains:
        ok = ok & domain_matches(host(url), list(allow_domains))
    return F.coalesce(ok, F.lit(False))


def validate_url(url: Column, *, allowed_domains: list[str] | None = None, blocked_domains: list[str] | None = None) -> Column:
    """'' for a URL that may be fetched, else why not: scheme, host, blocked, not_allowed or private."""
    h = host(url)
    private = h.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[?::1|\[?f[cd])") | h.endswith(".localhost")
    out = F.when(~F.coalesce(F.lower(part(url, "PROTOCOL")).isin("http", "https"), F.lit(False)), F.lit("scheme")).when(F.coalesce(h, F.lit("")) == "", F.lit("host"))
    if blocked_domains:
        out = out.when(domain_matches(h, blocked_domains), F.lit("blocked"))
    if allowed_domains:
        out = out.when(~domain_matches(h, allowed_domains), F.lit("not_allowed"))
    return out.when(private, F.lit("private")).otherwise(F.lit(""))


def comparable_url(url: Column, keep_fragment: bool = False) -> Column:
    """The canonical form of a URL with its query parameters in order, blank ones kept, and the fragment if wanted; for comparison, not for fetching."""
    base = canonical_url(url)
    pairs = F.array_sort(F.filter(F.split(query(url), "&"), lambda p: p != ""))
    rest = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))
    fragment = F.coalesce(F.concat(F.lit("#"), part(url, "REF")), F.lit("")) if keep_fragment else F.lit("")
    return F.concat(F.substring_index(base, "?", 1), rest, fragment)


def request_fingerprint(url: Column, method: Column | None = None, body: Column | None = None, session: Column | None = None, extra: Column | None = None) -> Column:
    """SHA-1, in hex, of a request: its comparable URL, method, body, session and, if given, a map of what else tells requests apart."""
    told = {"url": comparable_url(url), "method": F.upper(F.coalesce(method, F.lit("GET")) if method is not None else F.lit("GET")), "body": F.coalesce(body, F.lit("")) if body is not None else F.lit(""), "sid": F.coalesce(session, F.lit("")) if session is not None else F.lit("")}
    fields = [told[k].alias(k) for k in sorted(told)]
    if extra is not None:
        fields.append(F.transform(F.array_sort(F.map_entries(extra)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))).alias("extra"))
    return F.sha1(F.to_json(F.struct(*fields)).cast("binary"))


def next_page_urls(url: Column, most: int = 10) -> Column:
    """The URL with its first paging number, and the ones behind it; the URL alone if no parameter has a number for a page."""
    name = F.get(F.filter(F.transform(F.split(query(url), "&"), lambda p: F.regexp_extract(p, r"^([^=]+)=[0-9]+$", 1)), lambda k: (k != "") & F.lower(k).isin(*PAGINATION_NAMES)), F.lit(0))
    of = F.get(F.filter(F.split(query(url), "&"), lambda p: F.substring_index(p, "=", 1) == name), F.lit(0))
    number = F.regexp_replace(of, "^[^=]*=", "").cast("long")
    at = lambda n: F.concat(F.substring_index(url, "?", 1), F.lit("?"), F.array_join(F.transform(F.split(query(url), "&"), lambda p: F.when(F.substring_index(p, "=", 1) == name, F.concat(name, F.lit("="), n.cast("string"))).otherwise(p)), "&"))
    return F.when(name.isNull(), F.array(url)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), lambda k: at(number + k)))
