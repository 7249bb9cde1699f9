"""Text expressions: whitespace, tags, entities, amounts, waves. JVM-side."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._util import col_of

#: The standard library's table of HTML5 names: those that end in ``;`` and
#: the legacy ones that may do without.
FULL_NAMES = {k: v for k, v in html5.items() if k.endswith(";")}
LEGACY_NAMES = {k: v for k, v in html5.items() if not k.endswith(";")}
_LONGEST = max(map(len, LEGACY_NAMES))


def collapse_ws(c) -> Column:
    """FN-10: every run of (Unicode) whitespace becomes one space; trimmed."""
    return F.trim(F.regexp_replace(col_of(c), r"(?U)\s+", " "))


def strip_tags(c) -> Column:
    """FN-11: remove markup tags."""
    return F.regexp_replace(col_of(c), r"<[^>]+>", "")


def _code_point_to_string(cp: Column) -> Column:
    # UTF-32BE bytes of the code point, decoded natively
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def _windows_1252(byte: int) -> str:
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(byte)


def _table(names: dict[str, str]) -> Column:
    """One map literal, folded from JSON while the query is planned."""
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _numeric(ref: Column) -> Column:
    """The character of ``#169;`` or ``#xA9``: what the HTML standard puts in
    place of surrogates, of numbers beyond Unicode and of control bytes; no
    character that the standard forbids."""
    hexed = ref.rlike("^#[xX]")
    digits = F.regexp_extract(ref, "^#[xX]?0*([0-9a-fA-F]*);?$", 1)
    value = F.conv(F.concat(F.lit("0"), F.substring(digits, 1, 8)), 16, 10).cast("bigint")
    value = F.when(hexed, value).otherwise(F.concat(F.lit("0"), F.substring(digits, 1, 8)).try_cast("bigint"))
    beyond = (F.length(digits) > 8) | (value > 0x10FFFF) | value.between(0xD800, 0xDFFF) | (value == 0)
    controls = F.array(*[F.lit(_windows_1252(b)) for b in range(0x80, 0xA0)])
    forbidden = value.between(1, 8) | (value == 11) | value.between(14, 31) | (value == 127) | value.between(0xFDD0, 0xFDEF) \
        | (value.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return F.when(beyond, F.lit("\ufffd")).when(value.between(0x80, 0x9F), F.try_element_at(controls, (value - 127).cast("int"))) \
        .when(forbidden, F.lit("")).otherwise(_code_point_to_string(value))


def unescape(c) -> Column:
    """FN-11: decodes numeric and named entities in one left-to-right pass, so
    '&amp;lt;' becomes '&lt;' (not '<'). All HTML5 names count; a name without
    its semicolon, or one that no table has, is decoded by the longest legacy
    name it starts with ('&copyright' gives '©right')."""
    s = col_of(c)
    pieces = F.split(s, "&")
    full, legacy = _table(FULL_NAMES), _table(LEGACY_NAMES)

    def one(p: Column) -> Column:
        ref = F.regexp_extract(p, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
        rest = F.substring(p, F.length(ref) + 1, F.length(p))
        starts = [F.when(F.length(ref) > n, F.concat(F.try_element_at(legacy, F.substring(ref, 1, n)), F.substring(ref, n + 1, 40)))
                  for n in range(_LONGEST, 1, -1)]
        whole = F.when(ref.endswith(";"), F.try_element_at(full, ref)).otherwise(F.try_element_at(legacy, ref))
        decoded = F.when(ref == "", F.lit(None)).when(ref.startswith("#"), _numeric(ref)).otherwise(F.coalesce(whole, *starts))
        return F.when(decoded.isNotNull(), F.concat(decoded, rest)).otherwise(F.concat(F.lit("&"), p))

    tail = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    out = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(tail, one), ""))
    # fast path: nothing to decode
    return F.when(s.contains("&"), out).otherwise(s)


def parse_amount(c) -> Column:
    """FN-12: text price -> struct(amount decimal(18,2), currency, unit).

    '¥1,200/件' -> (1200.00, '¥', '件'); '350万' -> 3500000.00; anything
    without a number -> amount null. Currency is the first currency symbol or
    code found, unit the text after the last '/'.
    """
    s = F.trim(col_of(c))
    number = F.regexp_extract(s, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    scale = F.when(s.rlike(r"[0-9]\s*亿"), F.lit(100000000)).when(s.rlike(r"[0-9]\s*万"), F.lit(10000)).otherwise(F.lit(1))
    base = F.nullif(F.regexp_replace(number, ",", ""), F.lit("")).try_cast("decimal(20,4)")
    amount = (base * scale).try_cast("decimal(18,2)")
    currency = F.nullif(F.regexp_extract(s, r"(¥|￥|\$|€|£|RMB|CNY|USD|EUR|GBP|元)", 1), F.lit(""))
    unit = F.nullif(F.regexp_extract(s, r"/\s*([^/\s]+)\s*$", 1), F.lit(""))
    return F.struct(amount.alias("amount"), currency.alias("currency"), unit.alias("unit"))


def wave(ts, grain: str = "day") -> Column:
    """FN-13: observation time truncated to the panel wave."""
    return F.date_trunc(grain, col_of(ts))
