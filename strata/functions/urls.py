"""URL expressions, all JVM-side (no Python UDF).

``resolve_url`` follows RFC 3986 reference resolution with the same
non-strict details as the Python standard library's ``urljoin`` (empty
query / fragment dropped, empty middle segments of a merged relative path
collapsed, ``..`` above the root ignored).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._util import col_of

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HAS_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_AUTH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"^[^#]*#(.*)$"
_DOT_SEGMENT = r"(^|/)\.\.?(/|$)"

# Scheme lists of the standard library's urllib.parse
# (schemes that take relative references / carry a network location).
USES_RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
                 "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
                 "svn+ssh", "ws", "wss"]
USES_NETLOC = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
               "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn",
               "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]


def _clean(c: Column) -> Column:
    # tabs and line breaks are removed anywhere, surrounding blanks trimmed
    return F.trim(F.regexp_replace(c, r"[\t\r\n]", ""))


def url_parts(url) -> dict[str, Column]:
    u = col_of(url)
    return {
        "scheme": F.lower(F.regexp_extract(u, _SCHEME, 1)),
        "netloc": F.regexp_extract(u, _AUTH, 1),
        "path": F.regexp_extract(u, _PATH, 1),
        "query": F.regexp_extract(u, _QUERY, 1),
        "fragment": F.regexp_extract(u, _FRAGMENT, 1),
    }


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column,
             fragment: Column) -> Column:
    body = (
        F.when(netloc != "", F.concat(
            F.lit("//"), netloc,
            F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when((scheme != "") & scheme.isin(USES_NETLOC) & ((path == "") | path.startswith("/")),
              F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        body,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def _collapse_middle(segs: Column) -> Column:
    return F.when(F.size(segs) <= 2, segs).otherwise(F.concat(
        F.slice(segs, 1, 1),
        F.filter(F.slice(segs, F.lit(2), F.size(segs) - 2), lambda s: s != ""),
        F.slice(segs, -1, 1),
    ))


def _remove_dots(segs: Column) -> Column:
    empty = F.array().cast("array<string>")
    resolved = F.aggregate(
        segs, empty,
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
                                         .otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.element_at(segs, -1)
    resolved = F.when(tail.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)
    joined = F.array_join(resolved, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def href_struct(href) -> Column:
    """Parse a (cleaned) reference once into its parts."""
    h = col_of(href)
    return F.struct(
        h.alias("h"),
        h.rlike(_HAS_SCHEME).alias("has_scheme"),
        F.lower(F.regexp_extract(h, _SCHEME, 1)).alias("scheme"),
        F.regexp_extract(h, _AUTH, 1).alias("netloc"),
        h.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//").alias("has_auth"),
        F.regexp_extract(h, _PATH, 1).alias("path"),
        F.regexp_extract(h, _QUERY, 1).alias("query"),
        F.regexp_extract(h, _FRAGMENT, 1).alias("fragment"),
    )


def base_struct(base) -> Column:
    """Parse a base URL once: its parts plus its directory."""
    b = _clean(col_of(base))
    p = url_parts(b)
    return F.struct(b.alias("b"), p["scheme"].alias("scheme"), p["netloc"].alias("netloc"),
                    p["path"].alias("path"), p["query"].alias("query"),
                    F.regexp_replace(p["path"], r"[^/]*$", "").alias("dir"))


def resolve_parts(bp: Column, hp: Column) -> Column:
    """FN-4 from pre-parsed parts (``base_struct``, ``href_struct``)."""
    h, h_path = hp["h"], hp["path"]
    scheme = F.when(hp["has_scheme"], hp["scheme"]).otherwise(bp["scheme"])
    absolute = h_path.startswith("/")
    merged = F.when(absolute, h_path).otherwise(F.concat(bp["dir"], h_path))
    simple = ~merged.rlike(_DOT_SEGMENT) & (absolute | ~merged.contains("//"))
    segs = F.when(absolute, F.split(h_path, "/")).otherwise(
        _collapse_middle(F.concat(F.split(bp["dir"], "/"), F.split(h_path, "/"))))
    path = F.when(simple, F.when(merged == "", F.lit("/")).otherwise(merged)).otherwise(_remove_dots(segs))
    empty_path_query = F.when(hp["query"] != "", hp["query"]).otherwise(bp["query"])
    return (
        F.when(bp["b"] == "", h)
        .when(h == "", bp["b"])
        .when(hp["has_scheme"] & ((scheme != bp["scheme"]) | ~scheme.isin(USES_RELATIVE)), h)
        .when(hp["has_auth"] & (hp["netloc"] != "") & scheme.isin(USES_NETLOC),
              _unsplit(scheme, hp["netloc"], h_path, hp["query"], hp["fragment"]))
        .when(h_path == "", _unsplit(scheme, bp["netloc"], bp["path"], empty_path_query, hp["fragment"]))
        .otherwise(_unsplit(scheme, bp["netloc"], path, hp["query"], hp["fragment"]))
    )


# References whose resolution is a plain concatenation / identity: a
# root-relative path, or an absolute lower-case http(s) URL with a host; no
# dot segments, no empty '?' or '#'. Checked before the general resolver,
# so the common case costs one regex match.
_FAST_ROOT = r"^/[^/?#][^?#]*(\?[^#]+)?(#.+)?$"
_FAST_ABS = r"^https?://[^/?#]+(/[^?#]*)?(\?[^#]+)?(#.+)?$"
_DOTS_ANYWHERE = r"(^|/)\.\.?(/|$|\?|#)"


def resolve_common(bp: Column, h: Column) -> Column:
    """FN-4 for the common forms only (root-relative path, absolute
    lower-case http(s) URL); null for every other reference."""
    fast_root = h.rlike(_FAST_ROOT) & ~h.rlike(_DOTS_ANYWHERE) & (bp["netloc"] != "") & bp["scheme"].isin(USES_RELATIVE)
    fast_abs = h.rlike(_FAST_ABS) & ~h.rlike(_DOTS_ANYWHERE)
    origin = F.concat(bp["scheme"], F.lit("://"), bp["netloc"])
    return F.when(fast_root, F.concat(origin, h)).when(fast_abs & (bp["b"] != ""), h)


def resolve_array(bp: Column, refs: Column) -> Column:
    """FN-4 over an array of cleaned references against one parsed base.

    Every element first takes the cheap common-form expression; only rows
    holding some other reference pay for the general resolver, which works
    on parts parsed once per element (a materialised array of structs).
    """
    common = F.transform(refs, lambda h: resolve_common(bp, h))
    general = F.transform(F.transform(refs, href_struct), lambda hp: resolve_parts(bp, hp))
    return F.when(F.forall(common, lambda x: x.isNotNull()), common).otherwise(general)


def resolve_url(base, href) -> Column:
    """FN-4: resolve ``href`` against ``base`` (both string columns).

    For large tables prefer ``with_resolved_url`` / ``resolve_parts``, which
    parse each side once.
    """
    return resolve_parts(base_struct(base), href_struct(_clean(col_of(href))))


def with_resolved_url(df, base: str, href: str, out: str = "url_resolved"):
    """Add ``out`` = FN-4(base, href), parsing each side in its own projection."""
    staged = df.withColumn("__bp", base_struct(base)).withColumn("__hp", href_struct(_clean(F.col(href))))
    return staged.withColumn(out, resolve_parts(F.col("__bp"), F.col("__hp"))).drop("__bp", "__hp")


def url_host(url) -> Column:
    """Lower-cased host of an absolute URL ('' when there is none)."""
    return F.lower(F.regexp_extract(col_of(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _quote(c: Column, safe: str) -> Column:
    """Percent-encode like the standard library's ``quote(s, safe)``.

    ``url_encode`` (Java URLEncoder) differs on three characters: space
    becomes '+', '*' stays, '~' is encoded. Fix those, then restore the
    requested safe characters ('%' last so '%2F' in the input survives).
    """
    out = F.url_encode(c)
    out = F.replace(out, F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    out = F.replace(out, F.lit("%7E"), F.lit("~"))
    for ch in [s for s in safe if s != "%"]:
        out = F.replace(out, F.lit("%%%02X" % ord(ch)), F.lit(ch))
    if "%" in safe:
        out = F.replace(out, F.lit("%25"), F.lit("%"))
    return out


def iri_to_uri(url) -> Column:
    """FN-5: percent-encode path (safe '/%'), query (safe '=&?/%:+') and
    fragment (nothing safe); scheme and network location untouched."""
    u = col_of(url)
    p = url_parts(u)
    has_netloc = u.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")
    return _unsplit(
        p["scheme"], F.when(has_netloc, p["netloc"]).otherwise(F.lit("")),
        _quote(p["path"], "/%"), _quote(p["query"], "=&?/%:+"), _quote(p["fragment"], ""))


def query_param(url, key: str) -> Column:
    """FN-6: value of one query parameter ('' when absent), percent-decoded."""
    q = F.regexp_extract(col_of(url), _QUERY, 1)
    raw = F.regexp_extract(F.concat(F.lit("&"), q), r"&" + _re_escape(key) + r"=([^&]*)", 1)
    return _decoded(raw)


def _decoded(raw) -> Column:
    """Percent-decoded; a malformed escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(raw), raw)


def query_map(url) -> Column:
    """FN-6: the whole query string as ``map<string,string>`` (last wins)."""
    q = F.regexp_extract(col_of(url), _QUERY, 1)
    pairs = F.filter(F.split(q, "&"), lambda s: s != "")
    kv = F.transform(pairs, lambda s: F.struct(
        _decoded(F.split_part(s, F.lit("="), F.lit(1))).alias("key"),
        _decoded(F.regexp_extract(s, r"^[^=]*=(.*)$", 1)).alias("value")))
    kv = F.filter(kv, lambda e: e["key"] != "")
    n = F.size(kv)
    later = lambda i: F.transform(F.slice(kv, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda e: e["key"])
    return F.map_from_entries(F.filter(kv, lambda e, i: ~F.array_contains(later(i), e["key"])))


def build_url(base, params: dict[str, object]) -> Column:
    """FN-7: append ``key=value`` pairs, URL-encoded, to a base path."""
    parts = [F.concat(F.lit(_py_quote_plus(k) + "="), _quote_plus(col_of_value(v)))
             for k, v in params.items()]
    if not parts:
        return col_of(base)
    return F.concat(col_of(base), F.lit("?"), F.concat_ws("&", *parts))


def _quote_plus(c: Column) -> Column:
    # standard-library ``urlencode`` uses quote_plus: space -> '+', '~' safe, '*' encoded
    out = F.url_encode(c)
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def _py_quote_plus(s: str) -> str:
    from urllib.parse import quote_plus
    return quote_plus(s)


def col_of_value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(str(v))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)
