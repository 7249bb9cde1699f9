"""DuckDB SQL fragments used by ``oracle_sql()`` in ``__spark_entry__``.

These are the independent flat-SQL statements of each operator's
semantics; they run on DuckDB over the same parquet tables.
"""

from __future__ import annotations

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
HAS_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
AUTH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
FRAGMENT = r"^[^#]*#(.*)$"
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
BARE_HREF = "regexp_replace(hrefs[i], '^[\"''](.*)[\"'']$', '\\1', 's')"
SHOWN = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({expr}, {lit(pattern)}, {group})"


def unescape_basic(expr: str) -> str:
    # decoded entities for href values in the test pages (no others occur)
    out = expr
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    return out


def resolve(b: str, h: str) -> str:
    """RFC 3986 resolution of href ``h`` against base ``b`` (urljoin rules)."""
    bscheme, bnet, bpath, bquery = (f"lower({rx(b, SCHEME)})", rx(b, AUTH), rx(b, PATH), rx(b, QUERY))
    hpath, hquery, hfrag = rx(h, PATH), rx(h, QUERY), rx(h, FRAGMENT)
    bdir = f"regexp_replace({bpath}, '[^/]*$', '')"
    joined = f"string_split({bdir}, '/') || string_split({hpath}, '/')"
    collapsed = (f"(CASE WHEN len({joined}) <= 2 THEN {joined} ELSE "
                 f"[({joined})[1]] || list_filter(({joined})[2:len({joined})-1], lambda x: x <> '') "
                 f"|| [({joined})[len({joined})]] END)")
    segs = f"(CASE WHEN starts_with({hpath}, '/') THEN string_split({hpath}, '/') ELSE {collapsed} END)"
    red = (f"list_reduce({segs}, lambda acc, x: CASE WHEN x = '..' THEN "
           f"(CASE WHEN len(acc) > 0 THEN acc[1:len(acc)-1] ELSE acc END) WHEN x = '.' THEN acc "
           f"ELSE list_append(acc, x) END, []::VARCHAR[])")
    red = f"(CASE WHEN ({segs})[len({segs})] IN ('.', '..') THEN list_append({red}, '') ELSE {red} END)"
    path = f"(CASE WHEN array_to_string({red}, '/') = '' THEN '/' ELSE array_to_string({red}, '/') END)"
    path = f"(CASE WHEN {bnet} <> '' AND NOT starts_with({path}, '/') THEN '/' || {path} ELSE {path} END)"
    q = f"(CASE WHEN {hquery} <> '' THEN '?' || {hquery} ELSE '' END)"
    fr = f"(CASE WHEN {hfrag} <> '' THEN '#' || {hfrag} ELSE '' END)"
    bq = f"(CASE WHEN {hquery} <> '' THEN '?' || {hquery} WHEN {bquery} <> '' THEN '?' || {bquery} ELSE '' END)"
    pre = f"{bscheme} || ':' || (CASE WHEN {bnet} <> '' THEN '//' || {bnet} ELSE '' END)"
    return (f"(CASE WHEN {b} = '' THEN {h} WHEN {h} = '' THEN {b} "
            f"WHEN regexp_matches({h}, {lit(HAS_SCHEME)}) THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {bscheme} || ':' || {h} "
            f"WHEN {hpath} = '' THEN {pre} || {bpath} || {bq} || {fr} "
            f"ELSE {pre} || {path} || {q} || {fr} END)")


def host(expr: str) -> str:
    return f"lower({rx(expr, HOST)})"


NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"


def links_cte(max_links: int | None = 20, allow: str | None = None, deny: str | None = None,
              page: str = SHOWN) -> str:
    """Kept links per page: first-seen order, capped, then filtered."""
    flt = []
    if allow:
        flt.append(f"regexp_matches(link, {lit(allow)})")
    if deny:
        flt.append(f"NOT regexp_matches(link, {lit(deny)})")
    where = ("WHERE " + " AND ".join(flt)) if flt else ""
    href = f"trim({unescape_basic(f'trim({BARE_HREF})')})"
    return f"""
hr AS (SELECT page_id, url, regexp_extract_all({page}, {lit(HREF)}, 1) AS hrefs FROM pages),
h1 AS (SELECT page_id, url, i, {href} AS href FROM hr, range(1, len(hrefs) + 1) t(i)),
h2 AS (SELECT page_id, i, {resolve('url', 'href')} AS link FROM h1 WHERE href <> ''),
h3 AS (SELECT page_id, link, min(i) AS first_i FROM h2 GROUP BY page_id, link),
h4 AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY first_i) AS rank FROM h3),
h5 AS (SELECT page_id, link, rank FROM h4 {"" if max_links is None else f"WHERE rank <= {max_links}"}),
kept AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS pos FROM h5 {where})"""


# Unicode white space (Java's (?U)\s), spelled out for RE2.
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

TITLE_EXPR = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"

ER = ("er AS (SELECT 'user:' || CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS entity_id, "
      "event_id, user_id, ts AS observed_at, event_type, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END "
      "AS status_code, sha256(props) AS content_hash, CASE WHEN event_type = 'error' THEN 'server error' END "
      "AS error, value FROM events)")

DR = ("dr AS (SELECT 'doc:' || CAST(d.doc_id AS VARCHAR) AS entity_id, d.doc_id, d.text, d.lang, d.source, "
      "d.n_chars, l.quality, l.toxic, sha256(d.text) AS content_hash FROM documents d "
      "LEFT JOIN labels l ON d.doc_id = l.doc_id)")

FL = ("fl AS (SELECT event_id, event_type || '.example.com' AS host, 'https://' || event_type || "
      "'.example.com/e/' || CAST(event_id AS VARCHAR) AS source_url, ts AS fetched_at, CASE WHEN "
      "event_type = 'error' THEN 500 ELSE 200 END AS status_code FROM events)")

SUMMARY = ("sm AS (SELECT (SELECT count(*) FROM er) AS records, (SELECT coalesce(sum(n - 1), 0) FROM "
           "(SELECT entity_id, count(*) AS n FROM er WHERE entity_id <> '' GROUP BY 1 HAVING count(*) > 1)) AS dup, "
           "(SELECT coalesce(sum(n - 1), 0) FROM (SELECT content_hash, count(*) AS n FROM er WHERE "
           "content_hash <> '' GROUP BY 1 HAVING count(*) > 1)) AS shared, (SELECT count(*) FROM er WHERE "
           "error IS NOT NULL AND error <> '') AS errs)")


NOTES_VALUES = ("SELECT 1, 'errors', 'error_records=' || errs FROM sm UNION ALL SELECT 2, 'duplicate_ids', "
                "'duplicate_entity_ids=' || dup FROM sm UNION ALL SELECT 3, 'shared_hashes', 'shared_hash_rows=' || shared "
                "FROM sm UNION ALL SELECT 4, 'no_records', 'records=' || records FROM sm UNION ALL SELECT 5, 'all_clear', "
                "'records=' || records FROM sm")

DR_FIELDS = [("content_hash", "s"), ("doc_id", "n"), ("entity_id", "s"), ("lang", "s"), ("n_chars", "n"),
             ("quality", "n"), ("source", "s"), ("text", "s"), ("toxic", "n")]


def missing_values_sql() -> str:
    parts = []
    for name, kind in DR_FIELDS:
        cond = f"{name} IS NULL OR {name} = ''" if kind == "s" else f"{name} IS NULL"
        parts.append(f"SELECT {lit(name)} AS field, CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS missing, "
                     f"round(CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE {cond}) AS DOUBLE) * 100.0 / "
                     f"count(*) ELSE 0.0 END, 4) AS rate FROM dr")
    return f"WITH {DR} " + " UNION ALL ".join(parts)


def doc_lines(min_share: float = 0.5, min_pages: int = 3) -> str:
    """Lines per (source, doc), boilerplate set, per-doc line counts."""
    return (
        "lines AS (SELECT DISTINCT source AS grp, doc_id AS key, line FROM (SELECT source, doc_id, "
        f"trim(regexp_replace(raw, {lit(WS)}, ' ', 'g')) AS line FROM (SELECT source, doc_id, "
        "unnest(string_split(text, chr(10))) AS raw FROM documents)) WHERE line <> ''), "
        "per_line AS (SELECT grp, line, count(*) AS pages_with_line FROM lines GROUP BY 1, 2), "
        "per_group AS (SELECT grp, count(*) AS pages FROM (SELECT DISTINCT source AS grp, doc_id AS key "
        "FROM documents) GROUP BY 1), "
        "bp AS (SELECT l.grp, l.line, l.pages_with_line, g.pages FROM per_line l JOIN per_group g USING (grp) "
        f"WHERE g.pages >= {min_pages} AND l.pages_with_line >= g.pages * {min_share}), "
        "per_key AS (SELECT key, count(*) AS n_lines, count(bp.line) AS n_bp FROM lines LEFT JOIN bp "
        "USING (grp, line) GROUP BY key)")


DOC_LINES = doc_lines()

BATCH = ("req AS (SELECT page_id * 1000 AS seq, url AS source_url FROM pages UNION ALL "
         "SELECT page_id * 1000 + pos, link FROM kept), arch AS (SELECT url AS source_url, 200 AS status_code, "
         "sha256(html) AS content_hash FROM pages), batch AS (SELECT r.seq, r.source_url, a.status_code, "
         "a.content_hash, CASE WHEN a.source_url IS NULL THEN 'no archived response' END AS error, "
         "CASE WHEN a.source_url IS NULL THEN 1 ELSE 0 END AS row_kind FROM req r LEFT JOIN arch a "
         "ON r.source_url = a.source_url)")

OBS_COLUMNS = ["entity_id", "城市", "月份", "日期", "AQI", "质量等级", "PM2.5", "PM10", "SO2", "NO2", "CO", "O3",
               "排名", "数据状态", "extraction_errors", "event_id"]

OBS = (
    "ev AS (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS city, strftime(ts, '%Y%m') AS month, "
    "strftime(ts, '%Y-%m-%d') AS tp, json_extract_string(props, '$.k') AS aqi, CAST(value AS VARCHAR) AS pm25, "
    "CAST(user_id AS VARCHAR) AS rnk, event_type NOT IN ('error', 'signup') AS ok FROM events), "
    "obs AS (SELECT CASE WHEN ok THEN 'city-api:' || city || ':' || tp ELSE 'city-api:' || city || ':' || month "
    "|| ':no_data' END AS entity_id, city AS \"城市\", month AS \"月份\", CASE WHEN ok THEN tp ELSE '' END AS \"日期\", "
    "CASE WHEN ok THEN coalesce(aqi, '') ELSE '' END AS \"AQI\", CASE WHEN ok THEN event_type ELSE '' END AS "
    "\"质量等级\", CASE WHEN ok THEN pm25 ELSE '' END AS \"PM2.5\", '' AS \"PM10\", '' AS \"SO2\", '' AS \"NO2\", "
    "'' AS \"CO\", '' AS \"O3\", CASE WHEN ok THEN rnk ELSE '' END AS \"排名\", CASE WHEN ok THEN 'ok' ELSE "
    "'no_items' END AS \"数据状态\", CASE WHEN ok THEN NULL WHEN event_type = 'error' THEN 'upstream error' "
    "ELSE 'API returned no day-level items' END AS extraction_errors, event_id FROM ev)")


SAFE_NAMES = ["entity_id", "v2", "v3", "v4", "aqi", "v6", "pm2_5", "pm10", "so2", "no2", "co", "o3", "v13", "v14",
              "extraction_errors", "event_id"]


def safe_columns_sql() -> str:
    cols = ", ".join(f'"{src}" AS "{safe}"' for src, safe in zip(OBS_COLUMNS, SAFE_NAMES))
    return f"WITH {OBS} SELECT {cols} FROM obs"


def blocked(text: str) -> str:
    phrases = ["captcha", "access denied", "forbidden", "verify you are human", "验证码", "访问被拒绝"]
    return "(" + " OR ".join(f"contains(lower({text}), '{p}')" for p in phrases) + ")"


ROBOTS_SQL = (
    f"WITH u AS (SELECT page_id, url, {host('url')} AS h, CASE WHEN regexp_extract(url, "
    "'^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, "
    "'^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1) END AS path FROM pages), "
    f"hosts AS (SELECT DISTINCT {host('url')} AS host FROM pages WHERE {host('url')} LIKE 'blog.%'), "
    "rules AS (SELECT host, r.prefix, r.allow FROM hosts, (VALUES ('/', true), ('/en/', false), ('/en/1', true)) "
    "r(prefix, allow)), m AS (SELECT u.page_id, arg_max(r.allow, length(r.prefix) * 2 + CAST(r.allow AS INTEGER)) "
    "AS win FROM u JOIN rules r ON u.h = r.host AND starts_with(u.path, r.prefix) GROUP BY u.page_id) "
    "SELECT u.page_id, u.url, coalesce(m.win, true) AS allowed FROM u LEFT JOIN m ON u.page_id = m.page_id")


# What publication must hide, written for RE2.
HIDDEN_TEXT = [
    r"[\w.%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    r"(?i)bearer\s+[\w.~+/\-]+=*",
    r"(?i)\b(?:api_key|api-key|apikey|access_token|access-token|accesstoken|token|password|passwd|secret)\s*[:=]\s*[^\s,;]+",
    r"(?i)\b(?:cookie|set-cookie)\s*:\s*[^\r\n]+",
    r"\+\d[\d ()\-]{7,}\d|\(\d{2,5}\)[ \-]?\d{3,4}[ \-]\d{3,4}\b|\b\d{3}[ \-]\d{3,4}[ \-]\d{4}\b|\b1[3-9]\d{9}\b",
]


def _minimize_sql() -> str:
    out = "text"
    for pattern in HIDDEN_TEXT:
        out = f"regexp_replace({out}, {lit(pattern)}, '[redacted]', 'g')"
    return f"SELECT doc_id, {out} AS text FROM documents"


MINIMIZE_SQL = _minimize_sql()


def _quote(expr: str, safe: str) -> str:
    """Percent-encoding like the standard library's quote(x, safe):
    DuckDB's url_encode encodes everything but unreserved characters, then
    the safe ones are restored ('%' last)."""
    out = f"url_encode({expr})"
    for ch in [c for c in safe if c != "%"]:
        out = f"replace({out}, {lit('%%%02X' % ord(ch))}, {lit(ch)})"
    if "%" in safe:
        out = f"replace({out}, '%25', '%')"
    return out


def iri_to_uri(u: str) -> str:
    scheme, netloc = f"lower({rx(u, SCHEME)})", rx(u, AUTH)
    path = _quote(rx(u, PATH), "/%")
    query = _quote(rx(u, QUERY), "=&?/%:+")
    frag = _quote(rx(u, FRAGMENT), "")
    body = (f"(CASE WHEN {netloc} <> '' THEN '//' || {netloc} || (CASE WHEN {path} <> '' AND NOT "
            f"starts_with({path}, '/') THEN '/' || {path} ELSE {path} END) ELSE {path} END)")
    return (f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END || {body} || "
            f"(CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END) || "
            f"(CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END))")


# Legacy named references the HTML tokenizer also decodes without ';'.
_LEGACY = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("nbsp", " ")]


def unescape_html5(expr: str) -> str:
    """Entity decoding as the standard library's HTML tokenizer does it for
    the entities in the test pages: legacy names with or without ';',
    &middot; and &#39; with it, '&amp' last so '&amp;lt;' stays '&lt;'."""
    out = expr
    for name, ch in _LEGACY:
        out = f"regexp_replace({out}, {lit('&' + name + ';?')}, {lit(ch)}, 'g')"
    for ent, ch in [("&middot;", "·"), ("&apos;", "'"), ("&#39;", "'")]:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


_HIDDEN_BLOCKS = [r"(?s)<!--.*?-->"] + [rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "noscript", "svg")]


def title_text_sql() -> str:
    """EXT-1: title text, and every non-blank whitespace-collapsed text
    chunk outside script/style/noscript/svg (title included), joined by
    newlines."""
    visible = "html"
    for pattern in _HIDDEN_BLOCKS:
        visible = f"regexp_replace({visible}, {lit(pattern)}, '', 'g')"
    clean = f"trim(regexp_replace({unescape_html5('x')}, {lit(WS)}, ' ', 'g'))"
    chunks = f"list_filter(list_transform(regexp_split_to_array({visible}, '<[^>]*>'), lambda x: {clean}), lambda y: y <> '')"
    title = f"trim(regexp_replace({unescape_html5(rx('html', '(?is)<title[^>]*>(.*?)</title>'))}, {lit(WS)}, ' ', 'g'))"
    return f"SELECT page_id, {title} AS title, array_to_string({chunks}, chr(10)) AS text FROM pages"
