"""Ordered per-key operators (WIN-*), limits (LIM-*) and sets (SET-*).

Skew: a key (host, entity) may hold a third of all rows. A plain
``Window.partitionBy(key)`` would sort that key in one task, so the ordered
operators here split each key into (key, bucket) slices, where the bucket
is monotone in the order (a time grain, or a block of positions):

* inside a slice the window runs as usual (many slices -> many tasks);
* a per-slice summary (last values, row count) is computed with a partial
  aggregation, scanned per key over slices only — a table with one row per
  (key, bucket), tiny next to the data — and joined back on (key, bucket),
  which matches the slice partitioning, so the big side is not re-shuffled.

First-occurrence and best-attempt choices are plain aggregations
(``min_by`` / ``max_by``), which combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.plans.sizing import bounded_broadcast
from strata.functions._util import qcol


def _cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def split_lag(df: DataFrame, keys, order: list[str], cols: list[str], bucket: Column,
              prefix: str = "prev_") -> DataFrame:
    """``lag(c)`` for each ``c`` in ``cols`` per ``keys`` ordered by ``order``
    (the last order column should make it total), computed in slices; plus
    ``<prefix>exists``: whether the row has a predecessor at all."""
    keys = _cols(keys)
    staged = df.withColumn("__b", bucket)
    w_in = Window.partitionBy(*keys, "__b").orderBy(*order)
    inner = staged.select("*", F.row_number().over(w_in).alias("__rn"),
                          *[F.lag(qcol(c)).over(w_in).alias(f"__in_{c}") for c in cols])
    ord_struct = F.struct(*[qcol(o) for o in order])
    last = (staged.groupBy(*keys, "__b")
            .agg(F.max_by(F.struct(*[qcol(c).alias(c) for c in cols]), ord_struct).alias("__last")))
    carry = last.select(*keys, "__b", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b")).alias("__carry"))
    out = inner.join(carry, [*keys, "__b"], "left")
    prev = [F.when(F.col("__rn") == 1, F.col("__carry")[c]).otherwise(F.col(f"__in_{c}")).alias(prefix + c)
            for c in cols]
    has_prev = ((F.col("__rn") > 1) | F.col("__carry").isNotNull()).alias(prefix + "exists")
    return out.select(*[qcol(c) for c in df.columns], *prev, has_prev)


def split_row_number(df: DataFrame, keys, order: list[str], bucket: Column,
                     name: str = "position") -> DataFrame:
    """1-based position per ``keys`` ordered by ``order``, in slices: the
    position within the slice plus the row count of all earlier slices."""
    keys = _cols(keys)
    staged = df.withColumn("__b", bucket)
    w_in = Window.partitionBy(*keys, "__b").orderBy(*order)
    inner = staged.withColumn("__rn", F.row_number().over(w_in))
    counts = staged.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*keys, "__b", (F.sum("__n").over(
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    out = inner.join(before, [*keys, "__b"], "left")
    return out.select(*[qcol(c) for c in df.columns],
                      (F.coalesce(F.col("__before"), F.lit(0)) + F.col("__rn")).cast("bigint").alias(name))


def _tiebreak(columns: list[str]) -> Column:
    return F.xxhash64(*[F.to_json(F.struct(qcol(c))) for c in columns]) if columns else F.lit(0)


def first_seen(df: DataFrame, key, order: str, per=()) -> DataFrame:
    """WIN-1: keep the first occurrence of ``key`` (within ``per``) by
    ``order``. A ``min_by`` aggregation: combines map-side, no sort."""
    groups = [*_cols(per), *_cols(key)]
    rest = [c for c in df.columns if c not in groups]
    agg = df.groupBy(*groups).agg(F.min_by(F.struct(*[qcol(c) for c in rest]),
                                    F.struct(qcol(order).alias("o"), _tiebreak(rest).alias("tie"))).alias("__r"))
    return agg.select(*groups, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def latest_attempt(df: DataFrame, key: str = "source_url", ts: str = "fetched_at",
                   status: str = "status_code", error: str | None = "error") -> DataFrame:
    """WIN-2: per URL the best attempt: a success (2xx and no error) first,
    then the newest, then the larger ``content_hash``. One ``max_by`` aggregation.
    Of ``status``, ``ts``, ``error`` and ``content_hash`` those that ``df`` has
    count; the rows' own values settle what is left, so one row a URL remains
    whatever the columns."""
    have = lambda c: c is not None and c in df.columns
    ok = qcol(status).between(200, 299) if have(status) else F.lit(True)
    if have(error):
        ok = ok & (qcol(error).isNull() | (qcol(error) == ""))
    rest = [c for c in df.columns if c != key]
    # equal times (they are whole seconds) are settled by the content hash, then by the rows' own values
    value = lambda c: qcol(c) if have(c) and c != key else F.lit(None).cast("string")
    rank = F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), value(ts).alias("ts"), value("content_hash").alias("body"),
                    _tiebreak(rest).alias("tie"))
    if not rest:
        return df.select(qcol(key)).distinct()
    agg = df.groupBy(qcol(key)).agg(F.max_by(F.struct(*[qcol(c) for c in rest]), rank).alias("__r"))
    return agg.select(qcol(key), *[F.col("__r")[c].alias(c) for c in rest])


def crawl_schedule(urls: DataFrame, host: Column, seq: str, delay_seconds: float = 10.0,
                   block: int = 100_000) -> DataFrame:
    """WIN-3: planned start offset per host = delay × (position − 1), one
    page per ``delay`` and host (concurrency 1). Positions are computed in
    blocks of ``block`` sequence numbers so a hot host spans many tasks."""
    staged = urls.withColumn("host", host)
    ranked = split_row_number(staged, "host", [seq], F.floor(qcol(seq) / block), name="position")
    return ranked.withColumn("start_offset_s", (F.col("position") - 1) * F.lit(float(delay_seconds)))


def pacing_violations(log: DataFrame, host: str, ts: str, delay_seconds: float = 10.0,
                      tiebreak: str | None = None, grain: str = "hour") -> DataFrame:
    """WIN-4: fetches of a host closer than ``delay`` to the previous fetch
    of the same host. The first fetch of a host never violates."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    lagged = split_lag(log, host, order, [ts], F.date_trunc(grain, qcol(ts)))
    gap = F.unix_micros(qcol(ts)) - F.unix_micros(F.col("prev_" + ts))
    return (lagged.drop("prev_exists").withColumn("gap_s", gap / 1e6)
            .filter(F.col("gap_s").isNotNull() & (F.col("gap_s") < delay_seconds)))


def panel_duplicates(df: DataFrame, keys=("entity_id", "observed_at")) -> DataFrame:
    """WIN-5: rows sharing (entity_id, observed_at), with the group size.
    Counted by a partial aggregation and joined back (AQE splits hot keys)."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count")).filter("dup_count > 1")
    return df.join(counts, keys, "inner")


def coverage_drops(coverage: DataFrame, threshold: float = 0.2, wave: str = "wave",
                   entities: str = "entities") -> DataFrame:
    """WIN-6: waves whose entity count fell by more than ``threshold`` vs
    the previous wave. Runs over AGG-13's one-row-per-wave table only."""
    w = Window.orderBy(wave)
    prev = F.lag(entities).over(w)
    return (coverage.select(wave, entities, prev.alias("prev_entities"))
            .withColumn("drop_share", 1 - F.col(entities) / F.col("prev_entities"))
            .filter(F.col("prev_entities").isNotNull() & (F.col("drop_share") > threshold)))


def unit_changes(df: DataFrame, entity: str, ts: str, unit_cols: list[str],
                 tiebreak: str | None = None, grain: str = "day") -> DataFrame:
    """WIN-7: rows whose unit/currency differs from the entity's previous
    observation; the first observation is 'new', not a change."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    lagged = split_lag(df, entity, order, unit_cols, F.date_trunc(grain, qcol(ts)))
    changed = F.lit(False)
    for c in unit_cols:
        changed = changed | ~qcol(c).eqNullSafe(F.col("prev_" + c))
    first = ~F.col("prev_exists")
    return (lagged.withColumn("unit_status", F.when(first, "new").when(changed, "changed").otherwise("same"))
            .drop("prev_exists"))


def content_changes(df: DataFrame, entity: str, ts: str, chash: str, grain: str = "day",
                    tiebreak: str | None = None) -> DataFrame:
    """WIN-8: per (entity, wave) the last observation's content hash, and
    whether it is new / changed / same vs the entity's previous wave.

    The wave table (one row per entity and wave, from a partial ``max_by``)
    is what gets scanned per entity, so hot entities stay cheap."""
    order = F.struct(qcol(ts), *( [qcol(tiebreak)] if tiebreak else []))
    waves = (df.groupBy(qcol(entity), F.date_trunc(grain, qcol(ts)).alias("wave"))
             .agg(F.max_by(qcol(chash), order).alias("content_hash")))
    prev = F.lag("content_hash").over(Window.partitionBy(entity).orderBy("wave"))
    return (waves.withColumn("prev_hash", prev)
            .withColumn("change", F.when(F.col("prev_hash").isNull(), "new")
                        .when(F.col("prev_hash") != F.col("content_hash"), "changed").otherwise("same")))


def cap_per_group(df: DataFrame, per, order: list, n: int) -> DataFrame:
    """LIM-1: first ``n`` rows per group. ``row_number() <= n`` is planned
    with a partial window-group-limit before the shuffle (top-n map-side)."""
    w = Window.partitionBy(*_cols(per)).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def first_n(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """LIM-2: first ``n`` rows in order; falsy ``n`` keeps all (ordered).
    ``orderBy().limit()`` runs as a per-partition top-n then a merge."""
    ordered = df.orderBy(*order)
    return ordered.limit(n) if n else ordered


def sample_head(df: DataFrame, order: list, n: int = 3) -> DataFrame:
    """LIM-3: the first three rows of a result."""
    return df.orderBy(*order).limit(n)


def union_records(ok: DataFrame, failed: DataFrame) -> DataFrame:
    """SET-1: union of records with different columns (bag semantics)."""
    return ok.unionByName(failed, allowMissingColumns=True)


def new_and_gone(prev: DataFrame, curr: DataFrame, key: str) -> DataFrame:
    """SET-2: entities entering (in ``curr`` only) and leaving (``prev`` only)."""
    p = prev.select(qcol(key)).distinct()
    c = curr.select(qcol(key)).distinct()
    new = c.join(p, key, "left_anti").withColumn("status", F.lit("new"))
    gone = p.join(c, key, "left_anti").withColumn("status", F.lit("gone"))
    return new.unionByName(gone)


def wave_turnover(df: DataFrame, key: str, ts: str, grain: str = "day") -> DataFrame:
    """SET-2 between every two consecutive waves that have rows: ``(wave,
    key, status)``, 'new' in ``wave`` only or 'gone' since the wave before.
    Each (key, wave) stands for itself and for the wave after it; one
    aggregation tells which of both a key has. Waves are numbered over the
    one-row-per-wave table."""
    seen = df.select(qcol(key), F.date_trunc(grain, qcol(ts)).alias("wave")).filter(F.col("wave").isNotNull()).distinct()
    w = Window.orderBy("wave")  # one row per wave
    waves = seen.select("wave").distinct().select("wave", F.lead("wave").over(w).alias("next"), F.row_number().over(w).alias("no"))
    rows = seen.join(bounded_broadcast(waves), "wave")
    side = lambda wave, judged, now: F.struct(
        F.col(wave).alias("wave"), judged.alias("judged"), F.lit(now).alias("now"), F.lit(1 - now).alias("before"))
    sides = rows.select(qcol(key), F.explode(F.array(side("wave", F.col("no") > 1, 1), side("next", F.lit(True), 0))).alias("s"))
    both = (sides.filter(F.col("s.wave").isNotNull() & F.col("s.judged")).groupBy(qcol(key), F.col("s.wave").alias("wave"))
            .agg(F.max("s.now").alias("now"), F.max("s.before").alias("before")))
    return (both.filter(F.col("now") != F.col("before"))
            .select("wave", qcol(key), F.when(F.col("now") == 1, "new").otherwise("gone").alias("status")))
