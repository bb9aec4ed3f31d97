"""Column functions on texts: cleaning, numbers, money, places, titles, keywords."""

from __future__ import annotations

from collections.abc import Callable
from http import HTTPStatus

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, places and patterns that results depend on.
CHALLENGE_PATTERNS = (
    "cf-challenge", "cf-browser-verification", "cf-mitigated", "cf-chl-bypass", "checking your browser", "just a moment",
    "attention required", "captcha", "hcaptcha", "recaptcha", "geetest", "_incapsula_resource", "请完成安全验证", "人机验证", "验证码", "安全验证",
)
PAGE_CHALLENGE_PATTERNS = (
    "cf-challenge", "cf-browser-verification", "checking your browser", "just a moment", "captcha", "hcaptcha", "recaptcha", "geetest",
    "请完成安全验证", "人机验证", "验证码", "安全验证",
)
CHALLENGE_STATUS = (403, 406, 429, 503, 521, 522, 523, 525)
STRONG_HEADERS = ("cf-mitigated", "cf-chl-bypass", "x-amz-cf-id", "akamai-grn")
ACCESS_KEYWORDS = {
    "rate_limited": ("429", "too many requests", "rate limit", "throttle"),
    "forbidden": ("403", "forbidden", "access denied", "not authorized"),
    "login_required": ("login", "sign in", "account", "my account", "aanmelden", "inloggen"),
    "region_block": ("not available in your region", "region", "geo", "country", "blocked location"),
    "network_timeout": ("timeout", "timed out", "net::err_timed_out", "read timed out"),
    "tls_error": ("ssl", "tls", "certificate", "handshake"),
}
SITE_WORDS = {
    "ecommerce": ("product", "cart", "add to cart", "price", "sku", "checkout", "shop", "category", "variant", "size", "color", "shipping", "buy now", "wishlist"),
    "jobs": ("job", "career", "vacancy", "salary", "benefit", "remote", "hybrid", "apply", "requirements", "responsibilities", "recruit", "position"),
    "news": ("article", "author", "published", "headline", "news", "story", "editor", "subscribe", "breaking"),
    "directory": ("listing", "directory", "location", "address", "phone", "hours", "map", "service center", "store locator"),
}
FOOTER_MARKERS = ("相似职位", "其它招聘", "相关推荐", "公司信息", "温馨提示")
LEGAL_MARKERS = ("版权所有", "ICP备", "公网安备", "用户协议", "隐私政策", "Copyright", "All Rights Reserved")
CITIES = {
    "San Jose": ("United States", "California", "San Jose"),
    "San Francisco": ("United States", "California", "San Francisco"),
    "New York": ("United States", "New York", "New York"),
    "Palo Alto": ("United States", "California", "Palo Alto"),
    "Irvine": ("United States", "California", "Irvine"),
    "北京": ("China", "北京", "北京"),
    "上海": ("China", "上海", "上海"),
    "深圳": ("China", "广东", "深圳"),
    "广州": ("China", "广东", "广州"),
    "郑州": ("China", "河南", "郑州"),
    "苏州": ("China", "江苏", "苏州"),
    "南京": ("China", "江苏", "南京"),
    "杭州": ("China", "浙江", "杭州"),
    "成都": ("China", "四川", "成都"),
    "重庆": ("China", "重庆", "重庆"),
    "大连": ("China", "辽宁", "大连"),
}
PROXY_ERRORS = ("net::err_proxy", "net::err_tunnel", "connection refused", "connection reset", "connection timed out", "failed to connect", "could not resolve proxy")
AGENT_WORDS = ("ai agent", "agent", "llm", "智能体", "Agent开发", "多智能体", "大模型")
BENEFITS = ("福利", "五险一金", "奖金", "期权", "股权", "体检", "年假")
JOB_CATEGORIES = (("AI Agent - Marketing", ("marketing",)), ("AI Agent - Customer Success", ("customer success",)), ("AI Agent Development", ("agent", "智能体")), ("LLM Application Development", ("llm", "大模型")))
SALARY_PATTERNS = (
    r"(?i)USD\s*([0-9,]+)\s*-\s*([0-9,]+)\s*/\s*([A-Z]+)",
    r"\$\s*([0-9,]+)\s*(?:k|K)?\s*[-~]\s*\$?\s*([0-9,]+)\s*(?:k|K)?",
    r"([0-9]+(?:\.[0-9]+)?)\s*[-~]\s*([0-9]+(?:\.[0-9]+)?)\s*[kK]",
)
JOB_HEADINGS = ("岗位职责", "职位描述", "工作描述", "Job Summary", "职位要求", "Requirements")
NUMBER = r"-?\d+(?:\.\d+)?"


def clean_text(text: Column) -> Column:
    """White space, no-break spaces included, as one space; none at the ends; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+", " "))


def extract_number(value: Column) -> Column:
    """The first signed decimal of a text without its commas, else null."""
    return F.regexp_extract(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit(","), F.lit("")), NUMBER, 0).try_cast("double")


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first of the patterns that the text holds, in their order, or ''."""
    out = F.when(F.lit(False), F.lit(""))
    for p in patterns:
        out = out.when(text.contains(p.lower()), F.lit(p))
    return out.otherwise(F.lit(""))


def _head(text: Column, most: int | None) -> Column:
    """The text, or its first characters if a number is given."""
    whole = F.coalesce(text, F.lit(""))
    return whole if most is None else F.substring(whole, 1, most)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def challenge_in_html(html: Column, patterns: tuple[str, ...] = CHALLENGE_PATTERNS, sample: int | None = None) -> Column:
    """The first challenge pattern in a page; sample looks at so many characters alone."""
    return _bound(F.lower(_head(html, sample)), lambda t: first_match(t, patterns))


def is_challenge_status(status: Column) -> Column:
    return F.coalesce(status.isin(*CHALLENGE_STATUS), F.lit(False))


def challenge_in_response(status: Column, headers: Column, cookies: Column, html: Column) -> Column:
    """struct(challenge, confidence, reasons) of a response: status, header map, cookie map and body."""
    heads = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    jars = F.transform(F.map_keys(cookies), lambda k: F.lower(k))
    busy = F.coalesce(status.isin(429, 503), F.lit(False))
    ray = F.coalesce(F.array_contains(heads, "cf-ray"), F.lit(False)) & F.coalesce(status.isin(403, 429, 503), F.lit(False))
    strong = [(h, F.coalesce(F.array_contains(heads, h), F.lit(False))) for h in STRONG_HEADERS]
    abck = F.coalesce(F.array_contains(jars, "_abck"), F.lit(False))
    body = challenge_in_html(html)
    reasons = [F.when(busy, F.concat(F.lit("status="), status.cast("string")))]
    reasons += [F.when(hit, F.lit(f"header:{h}")) for h, hit in strong]
    reasons += [F.when(ray, F.lit("header:cf-ray+block_status"))]
    reasons += [F.when(F.coalesce(F.array_contains(jars, c), F.lit(False)), F.lit(f"cookie:{c}")) for c in ("__cf_bm", "cf_clearance", "_abck")]
    reasons += [F.when(body != "", F.concat(F.lit("body:"), body))]
    told = F.array_compact(F.array(*reasons))
    high = abck | ray
    name = F.coalesce(*[F.when(hit, F.lit(h)) for h, hit in strong], F.when(ray, F.lit("cf-ray")), F.when(abck, F.lit("akamai_abck")), F.nullif(body, F.lit("")))
    for _, hit in strong:
        high = high | hit
    confidence = F.when(high, F.lit("high")).when(busy, F.lit("low")).when(body != "", F.lit("high")).otherwise(F.lit("none"))
    none = name.isNull() & (confidence == "none")
    return F.struct(
        F.when(none, F.lit("")).otherwise(F.coalesce(name, F.get(told, F.lit(0)), F.lit("unknown"))).alias("challenge"),
        confidence.alias("confidence"),
        F.when(none, F.array().cast("array<string>")).otherwise(told).alias("reasons"),
    )


def access_categories(visible: Column, error: Column | None = None, status: Column | None = None, *, truncated: Column | None = None, js_shell: Column | None = None, api_hints: Column | None = None, sample: int | None = None) -> Column:
    """Why a page could not be read, and what it is like, by its visible text, error, status and signals; several may hold.

    sample looks at so many characters of the text alone. Each text is lowered once.
    """
    shown = _head(visible, sample)
    said = F.coalesce(error, F.lit("")) if error is not None else F.lit("")
    signals = [F.when(holds, F.lit(name)) for name, holds in (("html_truncated", truncated), ("js_shell", js_shell), ("api_hints_found", api_hints)) if holds is not None]
    statuses = [F.when(status == 429, F.lit("rate_limited")).when(status.isin(401, 403), F.lit("forbidden")).when(status >= 500, F.lit("server_error"))] if status is not None else []

    def judged(text: Column) -> Column:
        holds = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(text, w))
        found = [F.when(holds(PAGE_CHALLENGE_PATTERNS), F.lit("challenge")), *statuses]
        found += [F.when(holds(words) & (F.length(shown) <= 2000) if name == "login_required" else holds(words), F.lit(name)) for name, words in ACCESS_KEYWORDS.items()]
        return F.array_distinct(F.array_compact(F.array(*found, *signals)))

    none = F.when(said != "", F.array(F.lit("fetch_error"))).otherwise(F.array(F.lit("html_available")))
    return _bound(_bound(F.lower(F.concat(said, F.lit("\n"), shown)), judged), lambda out: F.when(F.size(out) > 0, out).otherwise(none))


def site_type_scores(text: Column, fields: list[str] = ()) -> dict[str, Column]:
    """Score of each site type: fifths of its words found, at most 1, with a bonus for requested fields."""
    lowered, wanted = F.lower(F.coalesce(text, F.lit(""))), " ".join(fields).lower()
    out = {}
    for name, words in SITE_WORDS.items():
        hits = sum((lowered.contains(w).cast("int") for w in words[1:]), lowered.contains(words[0]).cast("int"))
        score = F.least(F.lit(1.0), hits / 5)
        asked = {"ecommerce": ("price", "image", "sku", "color"), "jobs": ("salary", "location", "job", "requirements")}.get(name, ())
        out[name] = F.round(F.least(F.lit(1.0), score + 0.25) if any(a in wanted for a in asked) else score, 3)
    return out


def best_site_type(scores: dict[str, Column]) -> Column:
    """The type of the highest score, of equal ones the first; unknown below 0.2."""
    top = F.greatest(*scores.values())
    out = F.when(top < 0.2, F.lit("unknown"))
    for name, score in scores.items():
        out = out.when(score == top, F.lit(name))
    return out


def clean_description(text: Column, most: int | None = None) -> Column:
    """A job description without what follows footer marks (from the 101st character on) and legal marks; whole, or its first characters."""
    out = clean_text(text)
    for mark, least in [(m, 101) for m in FOOTER_MARKERS] + [(m, 1) for m in LEGAL_MARKERS]:
        out = _cut_at(out, mark, least)
    return F.trim(out) if most is None else F.substring(F.trim(out), 1, most)


def _cut_at(text: Column, mark: str, least: int) -> Column:
    """The text up to its first mark, if that stands at `least` or later. The text is bound once, so chains stay small."""
    return F.get(F.transform(F.array(text), lambda v: F.when(F.instr(v, mark) >= least, F.substring(v, F.lit(1), F.instr(v, mark) - 1)).otherwise(v)), F.lit(0))


def normalize_title(title: Column) -> Column:
    value = clean_text(title)
    low = F.lower(value)
    agent = low.contains("agent engineer") | low.contains("ai agent") | value.contains("智能体") | low.contains("agent开发") | (low.contains("ai engineer") & low.contains("agent"))
    return F.when(agent, F.lit("AI Agent Engineer")).when(low.contains("ai engineer"), F.lit("AI Engineer")).otherwise(value)


def job_category(title: Column, description: Column) -> Column:
    text = F.lower(F.concat(clean_text(title), F.lit(" "), clean_text(description)))
    out = F.when(F.lit(False), F.lit(""))
    for name, words in JOB_CATEGORIES:
        out = out.when(first_match(text, words) != "", F.lit(name))
    return out.otherwise(F.lit("AI Engineering"))


def normalize_location(raw: Column) -> Column:
    """struct(location_raw, country, province_state, city, is_remote); places joined by / in the order of CITIES."""
    value = clean_text(raw)
    low = F.lower(value)
    hits = F.array_compact(F.array(*[F.when(low.contains(a.lower()), F.struct(*[F.lit(x).alias(n) for n, x in zip(("country", "province", "city"), m, strict=True)])) for a, m in CITIES.items()]))
    joined = lambda k: F.array_join(F.array_distinct(F.transform(hits, lambda h: h[k])), "/")
    somewhere = value.contains("United States") | value.contains("California") | value.contains("New York")
    return F.struct(
        F.when(value.contains("未公开"), F.lit("")).otherwise(value).alias("location_raw"),
        F.when((F.size(hits) == 0) & somewhere, F.lit("United States")).otherwise(joined("country")).alias("country"),
        joined("province").alias("province_state"),
        joined("city").alias("city"),
        value.rlike("(?i)remote|远程").alias("is_remote"),
    )


def parse_salary(raw: Column) -> Column:
    """struct(salary_raw, currency, salary_min, salary_max, salary_period, salary_negotiable, benefits)."""
    value = clean_text(raw)
    none = (value == "") | value.contains("未公开")
    usd, short, cny = SALARY_PATTERNS
    whole = lambda p, i: F.replace(F.regexp_extract(value, p, i), F.lit(","), F.lit("")).try_cast("long")
    scaled = lambda n: F.when(n < 1000, n * 1000).otherwise(n)
    is_usd, is_short, is_cny = (~none & value.rlike(p) for p in (usd, short, cny))

    def pick(a: Column, b: Column, c: Column) -> Column:
        return F.when(is_usd, a).when(is_short, b).when(is_cny, c)

    amount = lambda i: pick(whole(usd, i), scaled(whole(short, i)), (F.regexp_extract(value, cny, i).try_cast("double") * 1000).cast("long"))
    return F.struct(
        value.alias("salary_raw"),
        F.coalesce(pick(F.lit("USD"), F.lit("USD"), F.lit("CNY")), F.lit("")).alias("currency"),
        amount(1).alias("salary_min"),
        amount(2).alias("salary_max"),
        F.coalesce(pick(F.upper(F.regexp_extract(value, usd, 3)), F.lit("YEAR"), F.lit("MONTH")), F.lit("")).alias("salary_period"),
        (~none & (value.contains("面议") | F.lower(value).contains("competitive"))).alias("salary_negotiable"),
        F.when(~none & (first_match(value, BENEFITS) != ""), value).otherwise(F.lit("")).alias("benefits"),
    )


def job_grade(status: Column, salary: Column, location: Column, description: Column) -> Column:
    """A to D by where the record comes from and whether salary, place and description are there."""
    paid = (F.coalesce(salary["salary_min"], F.lit(0)) > 0) & (F.coalesce(salary["salary_max"], F.lit(0)) > 0) | salary["salary_negotiable"]
    placed = (location["city"] != "") | (location["country"] != "") | location["is_remote"]
    told = F.length(description) >= 120
    return F.when((status == "parsed_jsonld") & paid & placed & told, F.lit("A")).when(status.startswith("parsed_") & told & (paid | placed), F.lit("B")).when(status.contains("fallback"), F.lit("C")).otherwise(F.lit("D"))


def http_status(error: Column) -> Column:
    """The status in an error text such as `HTTP 404` or `503 Server Error`."""
    a, b = F.regexp_extract(error, r"(?i)\bHTTP\s+(\d{3})\b", 1), F.regexp_extract(error, r"(?i)(\d{3})\s+(?:Client|Server) Error", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).try_cast("int")


def label(slug: Column) -> Column:
    """A slug as a title: dashes and underscores as spaces, words with capitals."""
    return F.initcap(F.trim(F.regexp_replace(slug, "[-_]+", " ")))


def safe_name(value: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[^a-z0-9_.-]+", "_"), r"^[_.-]+|[_.-]+$", ""), 1, most)


def css_escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([^A-Za-z0-9_-])", r"\\$1")


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in cells]), F.lit(" |"))


def regex_all(text: Column, pattern: str, group: int = 0, *, case_sensitive: bool = True, clean: bool = False) -> Column:
    """All matches of a Java pattern, or of one of its groups."""
    source = clean_text(text) if clean else text
    return F.regexp_extract_all(source, F.lit(pattern if case_sensitive else f"(?i){pattern}"), F.lit(group))


def sort_characters(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, "")), "")


def status_text(code: Column) -> Column:
    """The reason that goes with an HTTP status, or a text that says it is unknown."""
    table = F.create_map(*[F.lit(x) for s in HTTPStatus for x in (s.value, s.phrase)])
    return F.coalesce(table[code.cast("int")], F.lit("Unknown Status Code"))


def is_proxy_error(error: Column) -> Column:
    return _bound(F.lower(F.coalesce(error, F.lit(""))), lambda t: first_match(t, PROXY_ERRORS) != "")


def is_agent_related(text: Column, words: tuple[str, ...] = AGENT_WORDS) -> Column:
    return _bound(F.lower(F.coalesce(text, F.lit(""))), lambda t: first_match(t, words) != "")


def relaxed_json(text: Column) -> Column:
    """A JSON text out of an HTML comment, if it is in one; null if it isn't JSON."""
    inner = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^<!--", ""), r"-->\s*$", ""))
    plain = F.when(F.trim(text).startswith("<!--"), inner).otherwise(F.trim(text))
    return F.when(F.try_parse_json(plain).isNotNull() & (plain != ""), plain)


def value_summary(text: Column) -> Column:
    """struct(type, size, keys, preview) of a JSON text: of objects the keys, of lists those of the first item, of others the value."""
    keys = lambda t: F.coalesce(F.json_object_keys(t), F.array().cast("array<string>"))
    first = F.get_json_object(text, "$[0]")
    is_map, is_list = F.trim(text).startswith("{"), F.trim(text).startswith("[")
    return F.struct(
        F.when(is_map, F.lit("dict")).when(is_list, F.lit("list")).otherwise(F.lit("value")).alias("type"),
        F.when(is_map, F.size(keys(text))).when(is_list, F.json_array_length(text)).alias("size"),
        F.when(is_map, F.slice(keys(text), 1, 30)).when(is_list & F.coalesce(F.trim(first).startswith("{"), F.lit(False)), F.slice(keys(first), 1, 20)).otherwise(F.array().cast("array<string>")).alias("keys"),
        F.when(~is_map & ~is_list, F.substring(F.trim(text), 1, 200)).alias("preview"),
    )


def useful_text(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)).between(2, 2000), F.lit(False))


def retry_delay(retry_after: Column, attempt: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds to wait: what Retry-After says, else doubled with every attempt, with the jitter, at most `most`."""
    grown = F.lit(base) * F.pow(F.lit(2.0), attempt) + (jitter if jitter is not None else F.lit(0.0))
    return F.least(F.coalesce(F.trim(retry_after).try_cast("double"), grown), F.lit(most))


def salary_from_jsonld(job: Column) -> Column:
    """What a job posting (JSON-LD text) pays: currency, range or value, and unit; null if it says nothing."""
    at = lambda path: F.nullif(F.get_json_object(job, f"$.baseSalary.{path}"), F.lit(""))
    word = lambda path: F.coalesce(at(path), F.lit(""))
    low, high, one, plain = at("value.minValue"), at("value.maxValue"), at("value.value"), at("value")
    told = F.when(low.isNotNull() & high.isNotNull(), F.concat(word("currency"), F.lit(" "), low, F.lit("-"), high, F.lit(" / "), word("value.unitText")))
    told = told.when(one.isNotNull(), F.concat(word("currency"), F.lit(" "), one, F.lit(" / "), word("value.unitText")))
    return F.trim(told.when(~plain.startswith("{"), F.concat(word("currency"), F.lit(" "), plain)))


def location_from_jsonld(job: Column) -> Column:
    """Where a job posting (JSON-LD text) is: parts of its addresses by commas, places by slashes, Remote if it says so."""
    where = F.coalesce(F.get_json_object(job, "$.jobLocation"), F.get_json_object(job, "$.applicantLocationRequirements"))
    places = F.when(F.trim(where).startswith("["), F.from_json(where, "array<string>")).when(where.isNotNull(), F.array(where)).otherwise(F.array().cast("array<string>"))

    def one(place: Column) -> Column:
        address = F.coalesce(F.get_json_object(place, "$.address"), place)
        parts = [F.get_json_object(address, f"$.{k}") for k in ("addressLocality", "addressRegion", "addressCountry", "streetAddress")]
        bits = F.filter(F.transform(F.array(*parts), clean_text), lambda x: F.coalesce(x, F.lit("")) != "")
        return F.when(F.trim(address).startswith("{"), F.array_join(bits, ", ")).otherwise(clean_text(address))

    told = F.filter(F.transform(places, one), lambda x: x != "")
    remote = (F.get_json_object(job, "$.jobLocationType") == "TELECOMMUTE") & ~F.exists(told, lambda x: F.contains(x, F.lit("Remote")) | F.contains(x, F.lit("远程")))
    return F.array_join(F.array_distinct(F.when(F.coalesce(remote, F.lit(False)), F.concat(told, F.array(F.lit("Remote")))).otherwise(told)), " / ")


def generic_job(title: Column, page: Column, url: Column, channel: Column, most_title: int | None = None, most_text: int | None = None, tested: int | None = None) -> Column:
    """struct of a job record by a page's text alone (limits of characters are off unless given): title, description (from its first heading on), url, channel and status; null if it isn't about agents."""
    body = clean_text(page)
    low = F.lower(body)
    at = F.coalesce(*[F.nullif(F.instr(low, h.lower()), F.lit(0)) for h in JOB_HEADINGS])
    first = lambda c, most: c if most is None else F.substring(c, 1, most)
    about = is_agent_related(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), first(body, tested)))
    record = F.struct(first(clean_text(title), most_title).alias("title"), F.when(at.isNotNull(), first(F.substring(body, at, F.length(body)), most_text)).otherwise(body).alias("description"), url.alias("url"), channel.alias("source_channel"), F.lit("parsed_text").alias("fetch_status"))
    return F.when(about, record)
