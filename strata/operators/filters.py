"""Row flags and filters (FLT-4..8, AGG-9 boilerplate lines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from strata.functions._util import col_of, qcol
from strata.functions.text import collapse_ws
from strata.functions.urls import url_host
from strata.plans.sizing import bounded_broadcast
from strata.session import materialize

# Phrases that mark a blocked / challenge page (case-insensitive).
BLOCK_PHRASES = ["captcha", "access denied", "forbidden", "verify you are human", "验证码", "访问被拒绝"]
BLOCK_PATTERN = "(?i)(" + "|".join(BLOCK_PHRASES) + ")"


def blocked_text(text) -> Column:
    """Case-insensitive presence of any block phrase: the text is lower-cased
    once and each phrase found by a plain substring search (several times
    faster than a case-insensitive regex alternation over long texts)."""
    low = F.lower(col_of(text))
    out = F.lit(False)
    for phrase in BLOCK_PHRASES:
        out = out | low.contains(phrase)
    return out


def fallback_short_page(df: DataFrame, html: str | None, own: list[str], fallback: list[str],
                        min_chars: int = 1000, chars: str | None = None) -> DataFrame:
    """FLT-4: when the page text is shorter than ``min_chars``, take the
    metadata columns ``own`` from the ``fallback`` columns instead. ``chars``
    names the page's length where the text itself was left behind."""
    short = (qcol(chars) if chars else F.length(qcol(html))) < min_chars
    out = df.withColumn("used_fallback", short)
    for o, fb in zip(own, fallback):
        out = out.withColumn(o, F.when(short, qcol(fb)).otherwise(qcol(o)))
    return out


def line_key(line) -> Column:
    """96-bit fingerprint of a line (xxhash64 + murmur3): what is shuffled
    instead of the line text. Collisions are negligible (about 1e-5 expected
    at a trillion distinct lines)."""
    c = col_of(line)
    return F.struct(F.xxhash64(c).alias("h1"), F.hash(c).alias("h2"))


def text_lines(df: DataFrame, key: str, group: str, text: str, keep_text: bool = False) -> DataFrame:
    """Non-blank, whitespace-collapsed lines of a text column: one row per
    (group, key, line), the line as its fingerprint ``lk`` (plus the text
    when ``keep_text``). De-duplicated map-side before the shuffle."""
    # explicit null filters keep every consumer's plan identical, so Spark
    # reuses one shuffle of the lines instead of exploding the texts twice
    lines = (df.filter(qcol(group).isNotNull() & qcol(key).isNotNull())
             .select(qcol(group).alias("grp"), qcol(key).alias("key"),
                     F.explode(F.split(qcol(text), "\n")).alias("raw"))
             .select("grp", "key", collapse_ws("raw").alias("line")).filter("line != ''"))
    cols = ["grp", "key", line_key("line").alias("lk")] + (["line"] if keep_text else [])
    return lines.select(*cols).dropDuplicates(["grp", "key", "lk"])


#: Parts a group's rows are dealt to where they meet the group's one row.
SALTS = 32
#: At most so many lines are joined as frequent ones.
MAX_FREQUENT = 20_000


def page_counts(df: DataFrame, key: str, group: str) -> DataFrame:
    """``(grp, pages)``: distinct keys of each group that is not null."""
    return (df.select(qcol(group).alias("grp"), qcol(key).alias("key")).where("grp IS NOT NULL").distinct()
            .groupBy("grp").agg(F.count(F.lit(1)).alias("pages")))


def _with_pages(rows: DataFrame, pages: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` (with ``grp``) joined to their group's pages. ``spread`` deals
    a group's rows to ``SALTS`` parts and the group's row is repeated for each,
    so that a group that holds half of all rows spans many tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    return rows.withColumn("__salt", F.pmod(F.hash(spread), F.lit(SALTS))) \
        .join(pages.select("grp", "pages", salts), ["grp", "__salt"], how).drop("__salt")


def boilerplate_keys(df: DataFrame, key: str, group: str, text: str,
                     min_share: float = 0.5, min_pages: int = 3) -> DataFrame:
    """(group, line fingerprint, pages_with_line, pages) of boilerplate lines."""
    lines = text_lines(df, key, group, text)
    per_line = lines.groupBy("grp", "lk").agg(F.count(F.lit(1)).alias("pages_with_line"))
    return (_with_pages(per_line, page_counts(df, key, group), F.col("lk"))
            .filter((F.col("pages") >= min_pages) & (F.col("pages_with_line") >= F.col("pages") * min_share)))


def mark_lines(lines: DataFrame, marked: DataFrame, total: int) -> DataFrame:
    """``lines(grp, key, lk)`` with ``is_bp``: whether ``marked(grp, lk,
    pages_with_line)`` holds the line. The most frequent lines, each at least
    one of ``MAX_FREQUENT`` of all ``total`` line rows and so at most that many,
    are a summary that every task gets; their rows, which one key of a shuffle
    join would bring to one task, never move. All others are joined by key."""
    least = max(2, -(-total // MAX_FREQUENT))
    marked = marked.select("grp", "lk", "pages_with_line")
    often = F.broadcast(marked.where(F.col("pages_with_line") >= least).select("grp", "lk", F.lit(True).alias("__often")))
    rest = marked.where(F.col("pages_with_line") < least).select("grp", "lk", F.lit(True).alias("__seldom"))
    known = lines.join(often, ["grp", "lk"], "left")
    return known.where("__often").select("grp", "key", "lk", F.lit(True).alias("is_bp")).unionByName(
        known.where("__often IS NULL").join(rest, ["grp", "lk"], "left")
        .select("grp", "key", "lk", F.col("__seldom").isNotNull().alias("is_bp")))


def boilerplate_lines(df: DataFrame, key: str, group: str, text: str,
                      min_share: float = 0.5, min_pages: int = 3) -> DataFrame:
    """AGG-9: lines found on at least ``min_share`` of a group's (host's)
    pages, for groups with at least ``min_pages`` pages.

    Counting runs on line fingerprints (12 bytes a line, de-duplicated per
    page map-side, partial counts per (group, line)), so a hot host adds
    partial rows, not text, to the shuffle. The text of the winning lines
    is fetched afterwards with a semi join on the (small) winner set.
    """
    keys = boilerplate_keys(df, key, group, text, min_share, min_pages)
    lines = (df.select(qcol(group).alias("grp"), F.explode(F.split(qcol(text), "\n")).alias("raw"))
             .select("grp", collapse_ws("raw").alias("line")).filter("line != ''")
             .withColumn("lk", line_key("line")))
    texts = (lines.join(keys.select("grp", "lk"), ["grp", "lk"], "left_semi")
             .groupBy("grp", "lk").agg(F.any_value("line").alias("line")))
    return (keys.join(texts, ["grp", "lk"])
            .select(F.col("grp").alias(group), "line", "pages_with_line", "pages"))


def flag_text(df: DataFrame, key: str, group: str, title: str | None, text: str,
              boilerplate: DataFrame | None = None, min_share: float = 0.5, min_pages: int = 3) -> DataFrame:
    """FLT-5: empty title, blocked/captcha text, boilerplate-only body.

    boilerplate-only = every non-blank line of the text is a boilerplate line
    of its group (AGG-9). ``judged`` is false where that cannot be told: the
    group has under ``min_pages`` pages or is null. The line fingerprints are
    written once, frequent ones are marked where they are (``mark_lines``), and
    one aggregation folds the lines back per key; no line text is shuffled.
    """
    lines = materialize(text_lines(df, key, group, text), "lines")
    pages = page_counts(df, key, group)
    if boilerplate is None:
        per_line = lines.groupBy("grp", "lk").agg(F.count(F.lit(1)).alias("pages_with_line"))
        bp = _with_pages(per_line, pages, F.col("lk")).filter(
            (F.col("pages") >= min_pages) & (F.col("pages_with_line") >= F.col("pages") * min_share))
    else:
        given = boilerplate.select(F.col(group).alias("grp"), line_key("line").alias("lk")).distinct()
        bp = lines.join(given, ["grp", "lk"], "left_semi").groupBy("grp", "lk").agg(F.count(F.lit(1)).alias("pages_with_line"))
    per_key = (mark_lines(lines, materialize(bp, "boilerplate"), lines.count())
               .groupBy("key").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("is_bp").alias("n_bp")))
    title_blank = (collapse_ws(qcol(title)) == "") | qcol(title).isNull() if title else F.lit(False)
    base = df.select(qcol(key).alias("key"), qcol(group).alias("grp"), title_blank.alias("empty_title"),
                     blocked_text(qcol(text)).alias("blocked"))
    base = _with_pages(base, pages, F.col("key"), "left")
    return (base.join(per_key, "key", "left")
            .select(F.col("key").alias(key), "empty_title", "blocked",
                    ((F.coalesce(F.col("n_lines"), F.lit(0)) > 0) & (F.col("n_lines") == F.col("n_bp")))
                    .alias("boilerplate_only"),
                    F.coalesce(F.col("pages") >= min_pages, F.lit(False)).alias("judged")))


#: A wanted rank's range of values is cut into this many at each step.
CUTS = 256
#: A range of so few distinct values is not cut any more.
FEW = 1 << 16
_LARGEST = 1.7976931348623157e308


def exact_quantiles(df: DataFrame, value: str, group: str, shares: dict[str, float]) -> DataFrame:
    """``(__cat, __n, *shares)``: per group the smallest value that at least
    the share of its non-null values does not exceed, at every size.

    Selection by refinement: values are counted once (repeated ones meet
    map-side) and the counts written. For each group and share, the range that
    holds the wanted rank is cut into ``CUTS`` equal parts, the parts are
    counted, and the part with the rank is the next range, until it holds at
    most ``FEW`` distinct values, whose running counts then give the value. A
    step moves at most ``CUTS`` partial counts a group, share and task, and
    values far out, which make the other parts empty, only cost a step. Values
    are doubles in the cuts alone, so the result is a value of ``df``."""
    counts = materialize(
        df.select(qcol(group).alias("__cat"), qcol(value).alias("__v")).filter(F.col("__v").isNotNull())
        .groupBy("__cat", "__v").agg(F.count(F.lit(1)).alias("__c")), "value-counts")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("__share"), F.lit(share).alias("__q")) for name, share in shares.items()]))
    same = lambda a, b: F.col(f"{a}.__cat").eqNullSafe(F.col(f"{b}.__cat"))
    state = counts.groupBy("__cat").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__c").alias("__n"),
                                          F.count("*").alias("__d")) \
        .select("*", wanted.alias("__w")).select("__cat", "__n", "__w.__share", F.ceil(F.col("__n") * F.col("__w.__q")).alias("__rank"),
                                               F.lit(0).cast("long").alias("__before"), "__lo", "__hi", "__d")
    state = materialize(state, "ranges")
    inside = lambda: counts.alias("c").join(bounded_broadcast(state).alias("s"), same("c", "s") & F.col(
        "c.__v").between(F.col("s.__lo"), F.col("s.__hi")))
    while not state.where(F.col("__d") > FEW).isEmpty():
        v = F.col("c.__v").cast("double")
        # halves, so that no difference overflows; what is not finite has parts of its own
        lo, hi, at = (F.greatest(F.least(F.col(c).cast("double"), F.lit(_LARGEST)), F.lit(-_LARGEST)) / 2 for c in ("s.__lo", "s.__hi", "c.__v"))
        part = F.when(F.col("s.__d") <= FEW, 0).when(F.isnan(v), CUTS + 1).when(v > _LARGEST, CUTS).when(v < -_LARGEST, -1).when(
            lo >= hi, (F.col("c.__v") > F.col("s.__lo")).cast("int")).otherwise(
            F.least(F.floor((at - lo) / F.nullif(hi - lo, F.lit(0.0)) * CUTS), F.lit(CUTS - 1))).cast("int")
        parts = inside().groupBy("s.__cat", "s.__n", "s.__share", "s.__rank", "s.__before", part.alias("__part")).agg(
            F.sum("c.__c").alias("__c"), F.min("c.__v").alias("__lo"), F.max("c.__v").alias("__hi"), F.count("*").alias("__d"))
        upto = F.sum("__c").over(Window.partitionBy("__cat", "__share").orderBy("__part"))
        parts = parts.withColumn("__upto", F.col("__before") + upto).where(
            (F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__c") < F.col("__rank")))
        state = materialize(parts.select("__cat", "__n", "__share", "__rank", (F.col("__upto") - F.col("__c")).alias("__before"),
                                         "__lo", "__hi", "__d"), "ranges")
    upto = F.col("s.__before") + F.sum("c.__c").over(Window.partitionBy("s.__cat", "s.__share").orderBy("c.__v"))
    last = inside().select("s.__cat", "s.__n", "s.__share", "s.__rank", "c.__v", upto.alias("__upto")).where("__upto >= __rank")
    return last.groupBy("__cat").agg(F.max("__n").alias("__n"), *[
        F.min(F.when(F.col("__share") == name, F.col("__v"))).alias(name) for name in shares])


def flag_price(df: DataFrame, amount: str, category: str, k: float = 3.0, min_rows: int = 1) -> DataFrame:
    """FLT-6: unparseable, negative, outlier outside [Q1 − k·IQR, Q3 + k·IQR]
    of its category (exact quartiles). Categories of fewer than ``min_rows``
    prices are judged only if asked for: by default all are."""
    amt = qcol(amount)
    stats = exact_quantiles(df, amount, category, {"q1": 0.25, "q3": 0.75})
    joined = df.join(bounded_broadcast(stats), qcol(category).eqNullSafe(F.col("__cat")), "left")
    iqr = F.col("q3") - F.col("q1")
    judged = F.col("__n") >= min_rows
    return joined.select(
        *[qcol(c) for c in df.columns],
        amt.isNull().alias("unparseable"),
        F.coalesce(amt < 0, F.lit(False)).alias("negative"),
        F.coalesce(judged & ((amt < F.col("q1") - k * iqr) | (amt > F.col("q3") + k * iqr)), F.lit(False)).alias("outlier"),
    )


def flag_date(df: DataFrame, col: str, as_of: str, floor: str = "1990-01-01",
              fmt: str | None = None) -> DataFrame:
    """FLT-7: unparseable, future (after ``as_of``), unexpectedly old (before
    ``floor``). Text is parsed with ``try_to_timestamp`` (null, not error)."""
    c = qcol(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        ts = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    else:
        ts = c.cast("timestamp")
    return df.select(
        *[qcol(x) for x in df.columns],
        (ts.isNull() & c.isNotNull()).alias("unparseable_date"),
        F.coalesce(ts > F.lit(as_of).cast("timestamp"), F.lit(False)).alias("future_date"),
        F.coalesce(ts < F.lit(floor).cast("timestamp"), F.lit(False)).alias("too_old"),
    )


def allowed_domains(df: DataFrame, url: str, domains: DataFrame, domain_col: str = "domain") -> DataFrame:
    """FLT-8: keep rows whose URL host is listed (left-semi join on host).
    The domain list is broadcast only when its size is proven small."""
    d = domains.select(F.lower(F.col(domain_col)).alias("__host")).distinct()
    return df.join(bounded_broadcast(d), url_host(qcol(url)) == F.col("__host"), "left_semi")
