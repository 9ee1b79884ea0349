"""Greedy, order-preserving batches of whole segments under a limit.

A batch takes the next segment while its running size plus that segment stays
within the limit; otherwise the segment opens a new batch. A segment longer
than the limit is a batch of its own (never split).

Greedy batching is a scan with reset, so no plain window expresses it. The
segments of one document are gathered into one row (no larger than the
document row the source already holds), their lengths are folded with the
native ``aggregate`` higher-order function, which emits only the segment
numbers that open a batch, and one explode of openings + segments followed by
a running ``last(...)`` window numbers every segment. No join back, so the
segment pipeline runs once; everything is keyed by the document and reuses the
segment stage's hash partitioning: no Exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlinear.functions.text import fold, let
from interlinear.operators.segments import whole_text


def _unit_len(unit_col):
    return F.when(unit_col == "bytes", F.col("n_bytes")).otherwise(F.col("n_chars"))


# the number of every segment's batch; the state is two numbers
GREEDY_SQL = fold("{lens}", {"acc": "cast(-1 as bigint)", "b": "-1"}, "int", let(
    "nb", "if(s.acc < 0 or s.acc + x > {lim}, s.b + 1, s.b)",
    "named_struct('acc', if(nb > s.b, x, s.acc + x), 'b', nb, 'cur', array_append(s.cur, nb))"))


def _gather(segs: DataFrame, keys: list[str]):
    """Non-tail segments of each group as one sorted array ``segs``."""
    body = segs.filter("not is_tail")
    cols = ["seg_no"] + [c for c in body.columns if c not in keys + ["seg_no"]]
    gathered = body.groupBy(*keys).agg(
        F.expr(f"array_sort(collect_list(struct({', '.join(f'`{c}`' for c in cols)})))").alias("segs"))
    return gathered, cols, body.select(F.struct(*cols).alias("r")).schema["r"].dataType.simpleString()


def _number(gathered: DataFrame, keys: list[str], cols: list[str], row_type: str,
            limit_col: str, unit_col: str) -> DataFrame:
    """Fold each gathered row into batch openings and number its segments."""
    kl = [f"`{c}`" for c in keys + [limit_col, unit_col]]
    lens = f"transform(segs, x -> case when `{unit_col}` = 'bytes' then x.n_bytes else x.n_chars end)"
    numbers = (f"case when `{limit_col}` <= 0 then transform(segs, (x, i) -> i) else "  # every segment opens a batch
               + GREEDY_SQL.format(lens=lens, lim=f"`{limit_col}`") + " end")
    both = gathered.selectExpr(*kl, f"inline(zip_with(segs, {numbers}, (r, b) -> named_struct('r', r, 'batch_no', b)))")
    return both.selectExpr(*kl, *[f"r.`{c}` as `{c}`" for c in cols], "batch_no")


def assign_batches(segs: DataFrame, key: str = "doc_id", extra_keys: list[str] | None = None,
                   limit_col: str = "limit_value", unit_col: str = "limit_unit") -> DataFrame:
    """Segments (with limit columns) -> segments with ``batch_no``.

    One pass: the document's segments are gathered into one row (bounded by
    the document itself), the fold finds batch openings, and a single explode
    of markers + segments followed by a running ``last`` window numbers them.
    """
    keys = [key] + list(extra_keys or []) + [limit_col, unit_col]
    gathered, cols, row_type = _gather(segs, keys)
    return _number(gathered, keys[:-2], cols, row_type, limit_col, unit_col)


def with_limit(segs: DataFrame, limit: int, unit: str) -> DataFrame:
    if unit not in ("bytes", "chars"):
        raise ValueError(f"unit must be 'bytes' or 'chars', got {unit!r}")
    return segs.withColumn("limit_value", F.lit(int(limit)).cast("bigint")).withColumn("limit_unit", F.lit(unit))


def batch_segments(segs: DataFrame, limit: int, unit: str = "bytes", key: str = "doc_id") -> DataFrame:
    """B1 (bytes) / B2 (chars) for one limit."""
    return assign_batches(with_limit(segs, limit, unit), key)


LITERAL_LIMITS = 256  # provider rows that become a literal array; more are joined


def batch_by_providers(segs: DataFrame, providers, key: str = "doc_id") -> DataFrame:
    """Batch the same segments once per provider limit.

    ``providers``: a list of (provider, unit, limit) or a DataFrame
    ``(provider, limit_unit, limit_value)``. A few limits become a literal
    array on the gathered row (no join); a larger table meets the documents in
    an equi-join on a salt, so neither side is broadcast or held on the driver.
    Each document's segments are gathered once and never re-extracted.
    """
    gathered, cols, row_type = _gather(segs, [key])
    if isinstance(providers, DataFrame):
        table = providers.select("provider", "limit_unit", F.col("limit_value").cast("bigint").alias("limit_value"))
        if table.count() > LITERAL_LIMITS:
            salts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            g = gathered.withColumn("__salt", F.expr(f"cast(pmod(xxhash64(`{key}`), {salts}) as int)"))
            return _number(g.join(table.hint("merge"), "__salt").drop("__salt"), [key, "provider"], cols, row_type,
                           "limit_value", "limit_unit")
        providers = table.collect()
    arr = ", ".join(f"named_struct('provider', {_q(p)}, 'limit_unit', {_q(u)}, 'limit_value', cast({int(v)} as bigint))"
                    for p, u, v, *_ in providers)
    g = gathered.selectExpr(f"`{key}`", "segs", f"inline(array({arr}))")
    return _number(g, [key, "provider"], cols, row_type, "limit_value", "limit_unit")


def _q(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def batch_text(batched: DataFrame, key: str = "doc_id", extra_keys: list[str] | None = None) -> DataFrame:
    """One row per batch with its text (segments each + newline).

    A batch holds at most ``limit`` units unless it is one oversize segment,
    so the collected text per group is bounded by the limit or one segment.
    """
    keys = [key] + list(extra_keys or [])
    present = set(batched.columns)
    meta = [c for c in ("block_no", "sub", "piece", "kind", "level", "qdepth", "prefix", "src") if c in present]
    g = batched.groupBy(*keys, "limit_unit", "limit_value", "batch_no").agg(
        F.expr(f"array_sort(collect_list(struct(seg_no, text, n_bytes, n_chars{''.join(', ' + c for c in meta)})))").alias("parts"),
        F.expr("min(seg_no)").alias("first_seg"),
        F.expr("max(seg_no)").alias("last_seg"),
        F.expr("count(1)").alias("n_segments"),
        F.expr("sum(n_bytes)").alias("n_bytes"),
        F.expr("sum(n_chars)").alias("n_chars"),
    )
    return g.selectExpr(
        *[f"`{c}`" for c in keys], "limit_unit", "limit_value", "batch_no", "first_seg", "last_seg", "n_segments",
        "array_join(transform(parts, x -> concat(x.text, '\\n')), '') as text", "n_bytes", "n_chars",
        "n_segments = 1 and (case when limit_unit = 'bytes' then n_bytes else n_chars end) > limit_value as oversize",
        # the batch's segments travel with it: keyed alignment needs no join back
        "parts as segs")


def _limits_sql(limits) -> str:
    return "array(" + ", ".join(
        f"named_struct('provider', {_q(p)}, 'limit_unit', {_q(u)}, 'limit_value', cast({int(v)} as bigint))"
        for p, u, v, *_ in limits) + ")"


META = ("block_no", "sub", "piece", "kind", "level", "qdepth", "prefix", "src")


def _batch_rows(segs: DataFrame, limits, key: str) -> DataFrame:
    """Batches of every limit straight from the gathered document row."""
    meta = [c for c in META if c in segs.columns]
    gathered = segs.filter("not is_tail").groupBy(key).agg(F.expr(
        f"array_sort(collect_list(struct(seg_no, text, n_bytes, n_chars{''.join(', ' + c for c in meta)})))").alias("segs"))
    return _cut(gathered, limits, key)


def _cut(gathered: DataFrame, limits, key: str) -> DataFrame:
    """Batches of every limit from rows that hold a document's segments: lengths
    are folded per limit, and each batch is a slice of the row's segments. No
    explode to segments, no window, no second grouping, and a text is copied
    only into the batch that holds it. Below a limit of one every segment opens
    a batch, so nothing is folded."""
    k = f"`{key}`"
    numbers = GREEDY_SQL.format(lens="transform(segs, x -> if(p.limit_unit = 'bytes', x.n_bytes, x.n_chars))", lim="p.limit_value")
    firsts = let("b", numbers, "filter(sequence(0, size(b) - 1), i -> i = 0 or element_at(b, i + 1) > element_at(b, greatest(i, 1)))")
    starts = f"case when p.limit_value <= 0 then sequence(0, size(segs) - 1) else {firsts} end"
    cut = (f"flatten(transform(transform({_limits_sql(limits)}, p -> named_struct('p', p, 's', {starts})),"
           " y -> transform(y.s, (f, i) -> named_struct('p', y.p, 'b', i, 'parts',"
           " slice(segs, f + 1, coalesce(try_element_at(y.s, i + 2), size(segs)) - f)))))")
    rows = gathered.selectExpr(k, f"explode({cut}) as e").selectExpr(
        k, "e.p.provider as provider", "e.p.limit_unit as limit_unit", "e.p.limit_value as limit_value", "e.b as batch_no",
        "e.parts as segs")
    total = lambda u: f"aggregate(segs, cast(0 as bigint), (n, x) -> n + x.n_{u}) as n_{u}"
    rows = rows.selectExpr("*", total("bytes"), total("chars"))
    return rows.selectExpr(
        k, "provider", "limit_unit", "limit_value", "batch_no", "segs[0].seg_no as first_seg",
        "element_at(segs, -1).seg_no as last_seg", "cast(size(segs) as bigint) as n_segments",
        "array_join(transform(segs, x -> concat(x.text, '\\n')), '') as text", "n_bytes", "n_chars",
        "size(segs) = 1 and (case when limit_unit = 'bytes' then n_bytes else n_chars end) > limit_value as oversize", "segs")


def text_batches(segs: DataFrame, limit: int, unit: str = "bytes", key: str = "doc_id") -> DataFrame:
    """B1/B2 with B6: one row per batch with its text (``batch_text`` of
    ``batch_segments``, in one pass over the gathered document)."""
    if unit not in ("bytes", "chars"):
        raise ValueError(f"unit must be 'bytes' or 'chars', got {unit!r}")
    return _batch_rows(segs, [("", unit, limit)], key).drop("provider")


def document_batches(found: DataFrame, limit: int, unit: str = "bytes", key: str = "doc_id") -> DataFrame:
    """``text_batches`` of rows ``(key, segs)`` (``segments.document_segments``): a
    document's segments are one array already and are not gathered again."""
    if unit not in ("bytes", "chars"):
        raise ValueError(f"unit must be 'bytes' or 'chars', got {unit!r}")
    present = {f.name for f in found.schema["segs"].dataType.elementType.fields}
    fields = ", ".join(f"'{c}', x.{c}" for c in ("seg_no", "text", "n_bytes", "n_chars", *META) if c in present)
    own = "filter(segs, x -> not x.is_tail)" if "is_tail" in present else "segs"
    gathered = found.selectExpr(f"`{key}`", f"transform({own}, x -> named_struct({fields})) as segs").filter("size(segs) > 0")
    return _cut(gathered, [("", unit, limit)], key).drop("provider")


def text_batches_by_providers(segs: DataFrame, providers, key: str = "doc_id") -> DataFrame:
    """B7/B8 with B6: one row per provider and batch. ``providers`` as in
    ``batch_by_providers``; a table too long for a literal takes that way."""
    if isinstance(providers, DataFrame):
        rows = providers.select("provider", "limit_unit", "limit_value").limit(LITERAL_LIMITS + 1).collect()
        if len(rows) > LITERAL_LIMITS:
            return batch_text(batch_by_providers(segs, providers, key), key, ["provider"])
        providers = rows
    return _batch_rows(segs, providers, key)


def whole_batches(segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Application-level limit 0 = one request with the whole text (tail included)."""
    w = whole_text(segs, key)
    meta = [c for c in ("block_no", "sub", "piece", "kind", "level", "qdepth", "prefix", "src") if c in segs.columns]
    parts = segs.filter("not is_tail").groupBy(key).agg(
        F.expr(f"array_sort(collect_list(struct(seg_no, text{''.join(', ' + c for c in meta)})))").alias("segs"))
    return w.join(parts.hint("merge"), key, "left").select(
        key, F.lit(0).alias("batch_no"), F.col("whole").alias("text"),
        F.octet_length("whole").cast("bigint").alias("n_bytes"),
        F.char_length("whole").cast("bigint").alias("n_chars"),
        F.coalesce("segs", F.expr(f"array_sort(array())").cast(parts.schema["segs"].dataType)).alias("segs"))


def plan_summary(batches: DataFrame, providers: DataFrame, group_cols: list[str]) -> DataFrame:
    """Requests, units and oversize batches per provider and grouping,
    with ``ceil(requests / qps)`` as a floor on wall-clock seconds.

    ``rollup`` over a pre-aggregated input: the partial aggregation runs
    map-side, so even a hot group ships one row per task.
    """
    q = providers.select("provider", "qps")  # of any size: the planner knows it
    units = F.when(F.col("limit_unit") == "bytes", F.col("n_bytes")).otherwise(F.col("n_chars"))
    b = batches.withColumn("units", units)
    agg = b.rollup("provider", *group_cols).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum("units").alias("units"),
        F.max("units").alias("max_units"),
        F.sum(F.col("oversize").cast("int")).alias("n_oversize"),
    ).filter(F.col("provider").isNotNull())
    return agg.join(q, "provider", "left").withColumn(
        "min_seconds", F.ceil(F.col("n_requests") / F.col("qps")).cast("bigint"))
