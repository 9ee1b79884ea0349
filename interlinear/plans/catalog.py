"""Registered queries (one per operator of the inventory) and their DuckDB
oracles.

Every query reads the driver tables (or corpora Spark derives from them by a
narrow projection) in full. Oracles compute the expected answer straight from
the source columns; column names and types match the Spark side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlinear import dims
from interlinear.operators import batching as B
from interlinear.operators import segments as M
from interlinear.operators.render import render
from interlinear.operators.translate import Service
from interlinear.plans import corpora as C
from interlinear.plans import stub

STUB = Service(stub.stub_service)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


SEG_COLS = ["doc_id", "seg_no", "text", "n_bytes", "n_chars", "byte_start", "byte_end"]

# --- oracle building blocks (DuckDB SQL) ----------------------------------
NL = "chr(10)"
SEG_A = f"""seg_a AS (
  SELECT doc_id, lang, source, CAST(unnest(range(len(l))) AS INTEGER) AS seg_no, unnest(l) AS text
  FROM (SELECT doc_id, lang, source, string_split(text, {NL}) AS l FROM documents)),
seg_a_len AS (
  SELECT *, CAST(strlen(text) + 1 AS BIGINT) AS n_bytes, CAST(length(text) + 1 AS BIGINT) AS n_chars FROM seg_a)"""
RANGES = """CAST(coalesce(sum(n_bytes) OVER (PARTITION BY doc_id ORDER BY seg_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"""


def greedy_sql(src: str, limit_expr: str, unit_expr: str, keys: str = "doc_id") -> str:
    """Recursive-CTE greedy batching over ``src(keys, seg_no, n_bytes, n_chars, limit..)``."""
    on = " AND ".join(f"s.{k} = r.{k}" for k in keys.split(", "))
    rk = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""gs AS (SELECT {keys}, seg_no, {limit_expr} AS lim,
       CASE WHEN {unit_expr} = 'bytes' THEN n_bytes ELSE n_chars END AS n FROM {src}),
r AS (
  SELECT {keys}, seg_no, lim, n AS acc, 0 AS batch_no FROM gs WHERE seg_no = 0
  UNION ALL
  SELECT {rk}, s.seg_no, s.lim,
         CASE WHEN r.acc + s.n > s.lim THEN s.n ELSE r.acc + s.n END,
         r.batch_no + CASE WHEN r.acc + s.n > s.lim THEN 1 ELSE 0 END
  FROM r JOIN gs s ON {on} AND s.seg_no = r.seg_no + 1)"""


# --- segmentation ---------------------------------------------------------
def _segs_a(spark, sf):
    return M.extract_segments(C.lines_corpus(spark, sf))


@register("segments_lines", f"""WITH {SEG_A}
SELECT doc_id, seg_no, text, n_bytes, n_chars, {RANGES} AS byte_start,
       {RANGES} + n_bytes AS byte_end FROM seg_a_len""")
def q_segments_lines(spark, sf):
    return _segs_a(spark, sf).select(*SEG_COLS)


@register("segments_raw", f"""SELECT doc_id, 0 AS seg_no, replace(text, {NL}, ' ') AS text,
  CAST(strlen(text) + 1 AS BIGINT) AS n_bytes, CAST(length(text) + 1 AS BIGINT) AS n_chars,
  CAST(0 AS BIGINT) AS byte_start, CAST(strlen(text) + 1 AS BIGINT) AS byte_end FROM documents""")
def q_segments_raw(spark, sf):
    return M.extract_segments(C.raw_corpus(spark, sf)).select(*SEG_COLS)


@register("segments_chat", f"""SELECT conv_id, turn, seg_no, kind, level, text FROM (
  SELECT conv_id, turn, 0 AS seg_no, 'heading' AS kind, 2 AS level, role AS text FROM conversations
  UNION ALL
  SELECT conv_id, turn, 1, 'paragraph', 0, replace(text, {NL}, ' ') FROM conversations)""")
def q_segments_chat(spark, sf):
    s = M.extract_segments(C.chat_corpus(spark, sf))
    return s.select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"),
                    "seg_no", "kind", "level", "text")


@register("segments_table", """SELECT doc_id, seg_no, kind, text FROM (
  SELECT event_id AS doc_id, 0 AS seg_no, 'cell' AS kind, 'event_type' AS text FROM events
  UNION ALL SELECT event_id, 1, 'cell', 'user_id' FROM events
  UNION ALL SELECT event_id, 2, 'cell', event_type FROM events
  UNION ALL SELECT event_id, 3, 'cell', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 4, 'paragraph', 'Event ' || CAST(event_id AS VARCHAR) FROM events)""")
def q_segments_table(spark, sf):
    return M.extract_segments(C.sheet_corpus(spark, sf)).select("doc_id", "seg_no", "kind", "text")


@register("code_excluded", """SELECT event_id AS doc_id, CAST(5 AS BIGINT) AS n_segments,
  CAST(0 AS BIGINT) AS n_with_code FROM events""")
def q_code_excluded(spark, sf):
    s = M.extract_segments(C.sheet_corpus(spark, sf))
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count(F.when(F.col("text").contains('"k"'), 1)).alias("n_with_code"))


@register("inline_text", """SELECT p_partkey AS doc_id, 0 AS seg_no,
  p_name || ' costs `' || p_brand || '` and ' || p_type || ' ' || CAST(p_size AS VARCHAR) || ' units' AS text
  FROM part UNION ALL SELECT p_partkey, seg_no, '' FROM part, (VALUES (1), (2)) v(seg_no)""")
def q_inline_text(spark, sf):
    s = M.extract_segments(C.links_corpus(spark, sf))
    return s.select("doc_id", "seg_no", "text")


@register("empty_segments", """SELECT p_partkey AS doc_id, seg_no, '' AS text, CAST(1 AS BIGINT) AS n_bytes
  FROM part, (VALUES (1), (2)) v(seg_no)""")
def q_empty_segments(spark, sf):
    s = M.extract_segments(C.links_corpus(spark, sf))
    return s.filter(F.col("text") == "").select("doc_id", "seg_no", "text", "n_bytes")


@register("link_labels", """SELECT p_partkey AS doc_id, 0 AS seg_no, 0 AS pos, p_name AS label FROM part
  UNION ALL SELECT p_partkey, 0, 1, p_type FROM part
  UNION ALL SELECT p_partkey, 1, 0, '' FROM part
  UNION ALL SELECT p_partkey, 2, 0, '' FROM part""")
def q_link_labels(spark, sf):
    return M.link_labels(C.links_corpus(spark, sf))


@register("tight_list_carry", f"""SELECT conv_id, turn, 0 AS seg_no, replace(text, {NL}, '') || role AS text
  FROM conversations""")
def q_tight_list_carry(spark, sf):
    s = M.extract_segments(C.lists_corpus(spark, sf))
    return s.select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"), "seg_no", "text")


@register("tail_text", f"""SELECT conv_id, turn, 0 AS seg_no, role AS text, false AS is_tail,
  CAST(strlen(role) + 1 AS BIGINT) AS n_bytes FROM conversations
  UNION ALL SELECT conv_id, turn, 1, replace(text, {NL}, ''), true, CAST(NULL AS BIGINT) FROM conversations""")
def q_tail_text(spark, sf):
    s = M.extract_segments(C.tail_corpus(spark, sf))
    return s.select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"),
                    "seg_no", "text", "is_tail", "n_bytes")


@register("segment_ranges", f"""WITH {SEG_A}
SELECT doc_id, seg_no, n_chars, n_bytes, {RANGES} AS byte_start, {RANGES} + n_bytes AS byte_end FROM seg_a_len""")
def q_segment_ranges(spark, sf):
    return _segs_a(spark, sf).select("doc_id", "seg_no", "n_chars", "n_bytes", "byte_start", "byte_end")


@register("whole_text", f"""SELECT doc_id, text || {NL} AS whole FROM documents""")
def q_whole_text(spark, sf):
    return M.whole_text(_segs_a(spark, sf))


def _segment_rows(spark, sf, corpus):
    return M.extract_segments(corpus(spark, sf)).select("doc_id", "seg_no", "text")


@register("reference_links", """SELECT p_partkey AS doc_id, 0 AS seg_no, p_name || ' has ' || p_brand || ' and ' || p_type || ' pic ' || p_partkey
    || ' but [no]' AS text FROM part
  UNION ALL SELECT p_partkey, 1, 'Size ' || p_size FROM part""")
def q_reference_links(spark, sf):
    return _segment_rows(spark, sf, C.references_corpus)


@register("reference_labels", """SELECT p_partkey AS doc_id, 0 AS seg_no, pos,
  CASE pos WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE 'pic ' || p_partkey END AS label
  FROM part, (VALUES (0), (1), (2), (3)) v(pos)""")
def q_reference_labels(spark, sf):
    return M.link_labels(C.references_corpus(spark, sf))


@register("nested_containers", """SELECT p_partkey AS doc_id, seg_no, CASE seg_no WHEN 0 THEN p_name || p_brand
  WHEN 1 THEN p_type || ' lazy ' || p_partkey WHEN 2 THEN 'size ' || p_size || 'inner ' || p_partkey ELSE 'end' END AS text
  FROM part, (VALUES (0), (1), (2), (3)) v(seg_no)""")
def q_nested_containers(spark, sf):
    return _segment_rows(spark, sf, C.nested_corpus)


@register("split_cells", """SELECT p_partkey AS doc_id, seg_no, CASE seg_no WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN p_name || ' '
  WHEN 3 THEN '`' || p_brand || '` ' WHEN 4 THEN p_type WHEN 5 THEN ' e' WHEN 6 THEN 'x ' || p_partkey WHEN 7 THEN ' ' WHEN 8 THEN '&'
  ELSE ' y | z' END AS text FROM part, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) v(seg_no)""")
def q_split_cells(spark, sf):
    return _segment_rows(spark, sf, C.cells_corpus)


@register("render_split_cells", f"""SELECT p_partkey AS doc_id, '|a' || chr(9) || '<a>|b' || chr(9) || '<b>|' || {NL} || '| --- | --- |' || {NL} || '|'
  || p_name || ' ' || chr(9) || '<' || p_name || ' >`' || p_brand || '` ' || chr(9) || '<`' || p_brand || '` >**' || p_type || chr(9) || '<' || p_type
  || '>** e' || chr(9) || '< e>|[x ' || p_partkey || chr(9) || '<x ' || p_partkey || '>](u' || p_partkey || ') ' || chr(9) || '< >&amp;' || chr(9)
  || '<&> y \\| z' || chr(9) || '< y \\| z>|' || {NL} AS rendered FROM part""")
def q_render_split_cells(spark, sf):
    docs = C.cells_corpus(spark, sf)
    segs = M.extract_segments(docs).withColumn("translation", F.concat(F.lit("<"), "text", F.lit(">")))
    return render(docs, segs).select("doc_id", "rendered")


@register("emphasis_runs", """SELECT p_partkey AS doc_id, 0 AS seg_no, p_name || ' and ' || p_type || ' ' || p_partkey
  || ' a * b snake_case_x *open ' || p_type || ' in *' || p_partkey || ' foobarbaz' AS text FROM part""")
def q_emphasis_runs(spark, sf):
    return M.extract_segments(C.emphasis_corpus(spark, sf)).select("doc_id", "seg_no", "text")


@register("html_block_kinds", """SELECT doc_id, CAST(seg_no AS INTEGER) AS seg_no, 'after ' || n || ' of ' || doc_id AS text
  FROM labels, (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)) v(seg_no, n)""")
def q_html_block_kinds(spark, sf):
    return _segment_rows(spark, sf, C.html_kinds_corpus)


@register("corpus_totals", f"""WITH {SEG_A}
SELECT lang, source, count(DISTINCT doc_id) AS n_docs, count(*) AS n_segments, CAST(sum(n_bytes) AS BIGINT) AS total_bytes,
  CAST(sum(n_chars) AS BIGINT) AS total_chars FROM seg_a_len GROUP BY ROLLUP (lang, source)""")
def q_corpus_totals(spark, sf):
    docs = C.lines_corpus(spark, sf)
    return M.corpus_totals(M.extract_segments(docs), docs, ["lang", "source"])


@register("slice_by_range", f"""WITH {SEG_A}
SELECT doc_id, seg_no, {RANGES} AS byte_start, text || {NL} AS piece, true AS matches FROM seg_a_len""")
def q_slice_by_range(spark, sf):
    s = J.materialize(_segs_a(spark, sf))  # read twice
    return M.slice_by_range(s, M.whole_text(s)).select("doc_id", "seg_no", "byte_start", "piece", "matches")


@register("doc_totals", f"""WITH {SEG_A}
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_segments, CAST(sum(n_bytes) AS BIGINT) AS total_bytes,
       CAST(sum(n_chars) AS BIGINT) AS total_chars FROM seg_a_len GROUP BY doc_id""")
def q_doc_totals(spark, sf):
    return M.doc_totals(_segs_a(spark, sf))


# --- batching -------------------------------------------------------------
def _batch_oracle(limit: int, unit: str) -> str:
    return f"""WITH RECURSIVE {SEG_A}, {greedy_sql('seg_a_len', str(limit), f"'{unit}'")}
SELECT doc_id, seg_no, CAST(batch_no AS INTEGER) AS batch_no FROM r"""


def _batched_a(spark, sf, limit, unit):
    return B.batch_segments(_segs_a(spark, sf), limit, unit)


@register("batch_bytes", _batch_oracle(6000, "bytes"))
def q_batch_bytes(spark, sf):
    return _batched_a(spark, sf, 6000, "bytes").select("doc_id", "seg_no", "batch_no")


@register("batch_chars", _batch_oracle(2000, "chars"))
def q_batch_chars(spark, sf):
    return _batched_a(spark, sf, 2000, "chars").select("doc_id", "seg_no", "batch_no")


@register("batch_limit0", _batch_oracle(0, "bytes"))
def q_batch_limit0(spark, sf):
    return _batched_a(spark, sf, 0, "bytes").select("doc_id", "seg_no", "batch_no")


@register("batch_whole", f"""SELECT doc_id, 0 AS batch_no, text || {NL} AS text,
  CAST(strlen(text) + 1 AS BIGINT) AS n_bytes, CAST(length(text) + 1 AS BIGINT) AS n_chars FROM documents""")
def q_batch_whole(spark, sf):
    return B.whole_batches(_segs_a(spark, sf)).select("doc_id", "batch_no", "text", "n_bytes", "n_chars")


BATCH_TEXT_SQL = f"""WITH RECURSIVE {SEG_A}, {greedy_sql('seg_a_len', '2000', "'chars'")}
SELECT r.doc_id, CAST(r.batch_no AS INTEGER) AS batch_no, CAST(min(r.seg_no) AS INTEGER) AS first_seg,
  CAST(max(r.seg_no) AS INTEGER) AS last_seg, count(*) AS n_segments,
  string_agg(s.text || {NL}, '' ORDER BY s.seg_no) AS text,
  CAST(sum(s.n_bytes) AS BIGINT) AS n_bytes, CAST(sum(s.n_chars) AS BIGINT) AS n_chars,
  count(*) = 1 AND sum(s.n_chars) > 2000 AS oversize
FROM r JOIN seg_a_len s ON s.doc_id = r.doc_id AND s.seg_no = r.seg_no
GROUP BY r.doc_id, r.batch_no"""


@register("batch_text", BATCH_TEXT_SQL)
def q_batch_text(spark, sf):
    bt = B.text_batches(_segs_a(spark, sf), 2000, "chars")
    return bt.select("doc_id", "batch_no", "first_seg", "last_seg", "n_segments", "text", "n_bytes", "n_chars", "oversize")


@register("oversize_segments", f"""WITH RECURSIVE {SEG_A}, {greedy_sql('seg_a_len', '2000', "'bytes'")}
SELECT r.doc_id, CAST(r.batch_no AS INTEGER) AS batch_no, CAST(min(r.seg_no) AS INTEGER) AS first_seg,
  CAST(sum(s.n_bytes) AS BIGINT) AS n_bytes
FROM r JOIN seg_a_len s ON s.doc_id = r.doc_id AND s.seg_no = r.seg_no
GROUP BY r.doc_id, r.batch_no HAVING count(*) = 1 AND sum(s.n_bytes) > 2000""")
def q_oversize_segments(spark, sf):
    bt = B.text_batches(_segs_a(spark, sf), 2000, "bytes")
    return bt.filter("oversize").select("doc_id", "batch_no", "first_seg", "n_bytes")


PROVIDERS_SQL = dims.values_sql(dims.PROVIDERS, ["provider", "limit_unit", "limit_value", "qps"], "p")


def _provider_batches_sql() -> str:
    return f"""WITH RECURSIVE {SEG_A},
pseg AS (SELECT s.*, p.provider, p.limit_unit, p.limit_value FROM seg_a_len s CROSS JOIN {PROVIDERS_SQL}),
{greedy_sql('pseg', 'limit_value', 'limit_unit', 'doc_id, provider')},
bat AS (SELECT r.doc_id, r.provider, r.batch_no, count(*) AS n_seg,
          sum(CASE WHEN p.limit_unit = 'bytes' THEN p.n_bytes ELSE p.n_chars END) AS units,
          max(p.limit_value) AS limit_value, any_value(p.lang) AS lang,
          string_agg(p.text || chr(10), '' ORDER BY p.seg_no) AS text
        FROM r JOIN pseg p ON p.doc_id = r.doc_id AND p.provider = r.provider AND p.seg_no = r.seg_no
        GROUP BY r.doc_id, r.provider, r.batch_no)"""


@register("rebatch_many_limits", _provider_batches_sql() + """
SELECT provider, doc_id, CAST(count(*) AS BIGINT) AS n_batches, CAST(max(units) AS BIGINT) AS max_units
FROM bat GROUP BY provider, doc_id""")
def q_rebatch_many_limits(spark, sf):
    segs = _segs_a(spark, sf)
    bt = B.text_batches_by_providers(segs, dims.providers(spark))
    units = F.when(F.col("limit_unit") == "bytes", F.col("n_bytes")).otherwise(F.col("n_chars"))
    return bt.groupBy("provider", "doc_id").agg(F.count(F.lit(1)).alias("n_batches"), F.max(units).alias("max_units"))


@register("plan_summary", _provider_batches_sql() + f""",
summ AS (SELECT provider, lang, CAST(count(*) AS BIGINT) AS n_requests, CAST(sum(units) AS BIGINT) AS units,
          CAST(max(units) AS BIGINT) AS max_units,
          CAST(sum(CASE WHEN n_seg = 1 AND units > limit_value THEN 1 ELSE 0 END) AS BIGINT) AS n_oversize
        FROM bat GROUP BY ROLLUP (provider, lang))
SELECT s.*, p.qps, CAST(ceil(s.n_requests / p.qps) AS BIGINT) AS min_seconds
FROM summ s JOIN {PROVIDERS_SQL} ON p.provider = s.provider""")
def q_plan_summary(spark, sf):
    # the language travels in the document key: no second read of documents
    docs = C.lines_corpus(spark, sf).select(F.struct("doc_id", "lang").alias("doc"), "text")
    provs = dims.providers(spark)
    segs = M.extract_segments(docs, key="doc")
    bt = B.text_batches_by_providers(segs, provs, key="doc")
    bt = bt.withColumn("lang", F.col("doc.lang"))
    return B.plan_summary(bt, provs, ["lang"]).select(
        "provider", "lang", "n_requests", "units", "max_units", "n_oversize", "qps", "min_seconds")


# --- requests -------------------------------------------------------------
from interlinear.functions.hashing import pad_blocks  # noqa: E402
from interlinear.operators import requests as R  # noqa: E402
from interlinear.operators import responses as P  # noqa: E402
from interlinear.operators import translate as T  # noqa: E402

# Demo credentials for the registered queries (never real secrets).
DEMO = R.Credentials(
    baidu=R.Md5FormUser(appid="demo-appid", key="demo-key", salt="0"),
    tencent=R.SignedJsonUser(id="0", key="0", region="ap-beijing", projectid=0),
    niutrans=R.PlainFormUser(key="demo-apikey", dict_no="dict-1", memory_no="mem-1"),
)
TS = 1636111645
_DATE = R.utc_date(TS)
_SCOPE = f"{_DATE}/{R.TC3_SERVICE}/{R.TC3_TERMINATOR}"
_IPAD, _OPAD = pad_blocks(R.signing_key(DEMO.tencent.key, _DATE))
UTRIM_SQL = "regexp_replace({x}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')"


def _provider_batches(spark, sf):
    docs = C.lines_corpus(spark, sf).select(
        F.struct("doc_id", "lang").alias("doc"), "text")
    segs = M.extract_segments(docs, key="doc")
    bt = B.text_batches_by_providers(segs, dims.PROVIDERS, key="doc")
    # English documents ask for source auto-detection
    src = F.when(F.col("doc.lang") == "en", F.lit("auto")).otherwise(F.col("doc.lang"))
    return bt.select(F.col("doc.doc_id").alias("doc_id"), "provider", "batch_no", "text", "oversize",
                     "n_bytes", "n_chars", src.alias("from_lang"), F.lit("zh").alias("to_lang"))


def _requests(spark, sf):
    return R.build_requests(_provider_batches(spark, sf), DEMO, TS)


REQ_SQL = _provider_batches_sql() + f""",
req AS (SELECT doc_id, provider, CAST(batch_no AS INTEGER) AS batch_no, text,
          {UTRIM_SQL.format(x='text')} AS q,
          CASE WHEN lang = 'en' THEN 'auto' ELSE lang END AS from_lang, 'zh' AS to_lang,
          n_seg = 1 AND units > limit_value AS oversize FROM bat),
reql AS (SELECT *, string_split(q, chr(10)) AS lines FROM req),
tc AS (SELECT *, to_json({{'Source': from_lang, 'Target': to_lang, 'ProjectId': CAST(0 AS INTEGER),
          'SourceTextList': lines}}) AS payload FROM reql WHERE provider = 'tencent'),
tcs AS (SELECT *, sha256('{R.TC3_CANONICAL_PREFIX.replace(chr(10), "' || chr(10) || '")}' || sha256(payload)) AS creq FROM tc),
tsig AS (SELECT *, sha256(unhex('{_OPAD.hex()}') || unhex(sha256(unhex('{_IPAD.hex()}') ||
          encode('{R.TC3_ALGORITHM}' || chr(10) || '{TS}' || chr(10) || '{_SCOPE}' || chr(10) || creq)))) AS sign FROM tcs)"""


@register("form_md5", REQ_SQL + """
SELECT doc_id, batch_no, q, md5('demo-appid' || q || '0' || 'demo-key') AS sign FROM reql WHERE provider = 'baidu'""")
def q_form_md5(spark, sf):
    return _requests(spark, sf).filter("provider = 'baidu'").select("doc_id", "batch_no", "q", "sign")


@register("payload_json", REQ_SQL + """
SELECT doc_id, batch_no, payload FROM tc""")
def q_payload_json(spark, sf):
    return _requests(spark, sf).filter("provider = 'tencent'").select("doc_id", "batch_no", "payload")


@register("payload_sha256", REQ_SQL + """
SELECT doc_id, batch_no, sha256(payload) AS hashed_payload FROM tc""")
def q_payload_sha256(spark, sf):
    r = _requests(spark, sf).filter("provider = 'tencent'")
    return r.select("doc_id", "batch_no", F.sha2("payload", 256).alias("hashed_payload"))


@register("tc3_signature", REQ_SQL + """
SELECT doc_id, batch_no, sign AS signature FROM tsig""")
def q_tc3_signature(spark, sf):
    r = _requests(spark, sf).filter("provider = 'tencent'")
    return r.select("doc_id", "batch_no", F.col("sign").alias("signature"))


@register("auth_headers", REQ_SQL + f""",
hdr AS (SELECT doc_id, batch_no, unnest([
    {{'header': 'authorization', 'value': '{R.TC3_ALGORITHM} Credential=0/{_SCOPE}, SignedHeaders={R.TC3_SIGNED_HEADERS}, Signature=' || sign}},
    {{'header': 'content-type', 'value': '{R.TC3_CONTENT_TYPE}'}},
    {{'header': 'host', 'value': '{R.TC3_HOST}'}},
    {{'header': 'x-tc-action', 'value': '{R.TC3_ACTION}'}},
    {{'header': 'x-tc-version', 'value': '{R.TC3_VERSION}'}},
    {{'header': 'x-tc-region', 'value': 'ap-beijing'}},
    {{'header': 'x-tc-timestamp', 'value': '{TS}'}}]) AS h FROM tsig)
SELECT doc_id, batch_no, h.header AS header, h.value AS value FROM hdr""")
def q_auth_headers(spark, sf):
    r = _requests(spark, sf).filter("provider = 'tencent'")
    return r.select("doc_id", "batch_no", F.explode("headers").alias("header", "value"))


@register("form_plain", REQ_SQL + """
SELECT doc_id, batch_no, to_json({'src_text': q, 'from': from_lang, 'to': to_lang, 'apikey': 'demo-apikey',
  'dictNo': 'dict-1', 'memoryNo': 'mem-1'}) AS payload FROM reql WHERE provider = 'niutrans'""")
def q_form_plain(spark, sf):
    return _requests(spark, sf).filter("provider = 'niutrans'").select("doc_id", "batch_no", "payload")


@register("lang_pair", REQ_SQL + """
SELECT provider, from_lang, to_lang,
  CASE WHEN from_lang = 'auto' AND provider = 'niutrans' THEN 'rejected' ELSE 'ready' END AS status,
  count(*) AS n_requests FROM reql GROUP BY ALL""")
def q_lang_pair(spark, sf):
    r = _requests(spark, sf)
    return r.groupBy("provider", "from_lang", "to_lang", F.col("req_status").alias("status")).agg(F.count(F.lit(1)).alias("n_requests"))


# --- responses ------------------------------------------------------------
def _responses(spark, sf):
    return P.unify_responses(stub.stub_service(_requests(spark, sf)))


RESP_SQL = REQ_SQL + f""",
codes AS (SELECT * FROM {dims.values_sql(dims.ERROR_CODES, ['provider', 'code', 'meaning'], 'ec')}),
too_long AS (SELECT * FROM (VALUES ('baidu', '54005', 'long query request too frequent'),
  ('tencent', 'UnsupportedOperation.TextTooLong', 'text too long'),
  ('niutrans', '10003', 'request text too long')) AS tl(provider, code, msg)),
resp AS (SELECT r.doc_id, r.batch_no, r.provider,
  CASE WHEN r.oversize THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN r.oversize THEN NULL ELSE list_transform(r.lines, lambda x: '[zh] ' || x) END AS dst,
  CASE WHEN r.oversize THEN t.code END AS error_code,
  CASE WHEN r.oversize THEN t.msg END AS error_msg
  FROM reql r JOIN too_long t ON t.provider = r.provider)"""


def _parse_q(provider):
    def q(spark, sf):
        r = stub.stub_service(_requests(spark, sf)).filter(F.col("provider") == provider)
        fn = {"baidu": P.parse_pairs, "tencent": P.parse_list, "niutrans": P.parse_text}[provider]
        return fn(r).select("doc_id", "batch_no", "status", "dst", "error_code", "error_msg")
    return q


for _name, _prov in (("parse_pairs", "baidu"), ("parse_list", "tencent"), ("parse_text", "niutrans")):
    register(_name, RESP_SQL + f"""
SELECT doc_id, batch_no, status, dst, error_code, error_msg FROM resp WHERE provider = '{_prov}'""")(_parse_q(_prov))


@register("explain_error", RESP_SQL + """
SELECT r.doc_id, r.batch_no, r.provider, r.error_code, coalesce(c.meaning, 'unknown error') AS meaning,
  'error code: `' || r.error_code || '`' || chr(10) || 'error message: `' || r.error_msg || '`' || chr(10) ||
  'meaning: ' || coalesce(c.meaning, 'unknown error') || chr(10) || 'returned by the ' ||
  CASE r.provider WHEN 'baidu' THEN 'Baidu Translate API' WHEN 'tencent' THEN 'Tencent Cloud API' ELSE 'NiuTrans API' END
  AS error_text
FROM resp r LEFT JOIN codes c ON c.provider = r.provider AND c.code = r.error_code WHERE r.status = 'error'""")
def q_explain_error(spark, sf):
    e = P.format_error(P.explain_error(_responses(spark, sf), dims.error_codes(spark)))
    return e.filter("status = 'error'").select("doc_id", "batch_no", "provider", "error_code", "meaning", "error_text")


@register("error_summary", RESP_SQL + """
SELECT r.provider, r.status, r.error_code, coalesce(c.meaning, 'unknown error') AS meaning, count(*) AS n
FROM resp r LEFT JOIN codes c ON c.provider = r.provider AND c.code = r.error_code WHERE r.status <> 'ok'
GROUP BY ALL""")
def q_error_summary(spark, sf):
    return P.error_summary(P.explain_error(_responses(spark, sf), dims.error_codes(spark)))


@register("response_lines", RESP_SQL + """,
fl AS (SELECT doc_id, batch_no, provider, CAST(unnest(range(len(dst))) AS INTEGER) AS pos, unnest(dst) AS line
       FROM resp WHERE status = 'ok')
SELECT doc_id, provider, batch_no, pos, line,
  CAST(row_number() OVER (PARTITION BY doc_id, provider ORDER BY batch_no, pos) - 1 AS INTEGER) AS line_no FROM fl""")
def q_response_lines(spark, sf):
    return P.response_lines(_responses(spark, sf), extra_keys=["provider"])


@register("region_lookup", f"""WITH rg AS (SELECT * FROM {dims.values_sql(dims.REGIONS, ['region', 'doc'], 'rg')}),
asked AS (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'ap-seoul' WHEN 1 THEN 'nowhere-' || s_nationkey END AS r FROM supplier)
SELECT s_suppkey, coalesce(r, 'ap-beijing') AS region, coalesce(r, 'ap-beijing') IN (SELECT region FROM rg) AS region_ok FROM asked""")
def q_region_lookup(spark, sf):
    asked = _load(spark, sf, "supplier").selectExpr(
        "s_suppkey", "case s_nationkey % 3 when 0 then 'ap-seoul' when 1 then concat('nowhere-', s_nationkey) end as region")
    return R.region_lookup(asked, dims.regions(spark)).select("s_suppkey", "region", "region_ok")


# --- alignment and rendering ---------------------------------------------
from interlinear.operators import align as A  # noqa: E402
from interlinear.plans import jobs as J  # noqa: E402


def _tencent_pipeline(spark, sf):
    """Corpus A at the 2000-char provider limit through the stub service. The
    segments are read twice: for the requests and to put the lines back."""
    segs = J.materialize(_segs_a(spark, sf))
    batched = B.batch_segments(segs, 2000, "chars")
    bt = B.batch_text(batched).withColumn("provider", F.lit("tencent")) \
          .withColumn("from_lang", F.lit("en")).withColumn("to_lang", F.lit("zh"))
    resp = P.unify_responses(stub.stub_service(R.build_requests(bt, DEMO, TS)))
    ok = resp.filter(F.col("status") == "ok")
    lines = ok.select("doc_id", "batch_no", F.posexplode("dst").alias("pos", "line"))
    return segs, batched, lines


def _tencent_responses(spark, sf):
    """Same, keeping each batch row (with its segments) and its parsed lines."""
    segs = _segs_a(spark, sf)
    bt = B.text_batches(segs, 2000, "chars").withColumn("provider", F.lit("tencent")) \
          .withColumn("from_lang", F.lit("en")).withColumn("to_lang", F.lit("zh"))
    resp = P.unify_responses(stub.stub_service(R.build_requests(bt, DEMO, TS)))
    return resp.withColumn("dst", F.when(F.col("status") == "ok", F.col("dst")))


ALIGN_SQL = f"""WITH RECURSIVE {SEG_A}, {greedy_sql('seg_a_len', '2000', "'chars'")},
sb AS (SELECT s.*, CAST(r.batch_no AS INTEGER) AS batch_no FROM seg_a_len s JOIN r USING (doc_id, seg_no)),
bs AS (SELECT doc_id, batch_no, count(*) AS n_seg, sum(n_chars) AS units FROM sb GROUP BY ALL),
sbo AS (SELECT sb.*, NOT (bs.n_seg = 1 AND bs.units > 2000) AS ok FROM sb JOIN bs USING (doc_id, batch_no)),
okl AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1 AS INTEGER) AS line_no,
          '[zh] ' || text AS line FROM sbo WHERE ok)"""


@register("align_positional", ALIGN_SQL + """
SELECT s.doc_id, s.seg_no, o.line AS translation FROM sbo s LEFT JOIN okl o ON o.doc_id = s.doc_id AND o.line_no = s.seg_no""")
def q_align_positional(spark, sf):
    segs, batched, lines = _tencent_pipeline(spark, sf)
    return A.align_positional(segs, T.number_lines(lines)).select("doc_id", "seg_no", "translation")


@register("align_keyed", ALIGN_SQL + """
SELECT doc_id, seg_no, CASE WHEN ok THEN '[zh] ' || text END AS translation FROM sbo""")
def q_align_keyed(spark, sf):
    return A.align_in_batches(_tencent_responses(spark, sf)).select("doc_id", "seg_no", "translation")


@register("missing_translation", ALIGN_SQL + """
SELECT doc_id, seg_no, batch_no FROM sbo WHERE NOT ok""")
def q_missing_translation(spark, sf):
    aligned = A.align_in_batches(_tencent_responses(spark, sf))
    return A.missing_translation(aligned).select("doc_id", "seg_no", "batch_no")


def _plain_requests(spark, sf):
    """Corpus A at the 2000-char limit as requests (lines of each batch)."""
    bt = B.text_batches(_segs_a(spark, sf), 2000, "chars").withColumn("provider", F.lit("tencent")) \
          .withColumn("from_lang", F.lit("en")).withColumn("to_lang", F.lit("zh"))
    return R.with_query(bt)


@register("translate_by_table", ALIGN_SQL + """, known AS (SELECT doc_id, batch_no, seg_no, text FROM sbo)
SELECT doc_id, batch_no, list(CASE WHEN length(text) % 2 = 0 THEN '[zh] ' || text END ORDER BY seg_no) AS dst,
  CASE WHEN bool_and(length(text) % 2 = 0) THEN 'ok' ELSE 'partial' END AS status FROM known GROUP BY doc_id, batch_no""")
def q_translate_by_table(spark, sf):
    """A11 (a): a translation memory that knows the lines of even length (with
    a second, larger entry for each, which must not win)."""
    line = F.explode(F.split("text", "\n", -1)).alias("src")
    even = _load(spark, sf, "documents").select(line).filter("char_length(src) % 2 = 0").select(
        F.lit("en").alias("from_lang"), F.lit("zh").alias("to_lang"), "src",
        F.explode(F.array(F.concat(F.lit("[zh] "), "src"), F.concat(F.lit("~"), "src"))).alias("dst"))
    return T.via_table(_plain_requests(spark, sf), even).select("doc_id", "batch_no", "dst", "status")


def _every_third_fails(lines, from_lang, to_lang):
    if len(lines) % 3 == 0:
        raise RuntimeError("no answer")
    return ["[zh] " + x for x in lines[:len(lines) - (len(lines) % 3 == 2)]]


@register("translate_by_function", ALIGN_SQL + """, reqs AS (
  SELECT doc_id, batch_no, list('[zh] ' || text ORDER BY seg_no) AS l FROM sbo GROUP BY doc_id, batch_no)
SELECT doc_id, batch_no, CASE len(l) % 3 WHEN 0 THEN NULL WHEN 1 THEN l ELSE l[:-2] END AS dst,
  CASE len(l) % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'ok' ELSE 'partial' END AS status,
  CASE len(l) % 3 WHEN 0 THEN 'RuntimeError: no answer'
    WHEN 2 THEN len(l) || ' lines asked, ' || (len(l) - 1) || ' returned' END AS error_msg FROM reqs""")
def q_translate_by_function(spark, sf):
    """A11 (b): a user function that fails for some requests and answers others short."""
    return T.via_function(_plain_requests(spark, sf), _every_third_fails).select("doc_id", "batch_no", "dst", "status", "error_msg")


@register("extra_translation", ALIGN_SQL + """
SELECT o.doc_id, o.line_no, o.line FROM okl o ANTI JOIN sbo s ON s.doc_id = o.doc_id AND s.seg_no = o.line_no""")
def q_extra_translation(spark, sf):
    segs, batched, lines = _tencent_pipeline(spark, sf)
    return A.extra_translation(segs, T.number_lines(lines)).select("doc_id", "line_no", "line")


@register("alignment_report", ALIGN_SQL + """
SELECT doc_id, batch_no, CAST(count(*) AS BIGINT) AS n_segments,
  CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_lines,
  CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra,
  CAST(0 AS BIGINT) AS n_trimmed
FROM sbo GROUP BY doc_id, batch_no""")
def q_alignment_report(spark, sf):
    return A.report_in_batches(_tencent_responses(spark, sf))


def _status_sql(fail_expr: str, total_expr: str) -> str:
    return f"""CASE WHEN {fail_expr} = 0 THEN 'ok' WHEN {fail_expr} < {total_expr} THEN 'partial' ELSE 'failed' END"""


_CHAT_OK = f"length(replace(text, {NL}, ' ')) + 1 <= 2000"


@register("render_chat", f"""SELECT conv_id, turn,
  '## ' || role || {NL} || {NL} || '## [zh] ' || role || {NL} || {NL} || text ||
  CASE WHEN {_CHAT_OK} THEN {NL} || {NL} || '[zh] ' || replace(text, {NL}, ' ') ELSE '' END || {NL} AS rendered,
  CASE WHEN {_CHAT_OK} THEN 'ok' ELSE 'partial' END AS status FROM conversations""")
def q_render_chat(spark, sf):
    out = J.translate_corpus(C.chat_corpus(spark, sf), J.JobConfig(), STUB)
    return out.select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"), "rendered", "status")


@register("render_table", f"""SELECT event_id AS doc_id,
  '|event_type' || chr(9) || '[zh] event_type|user_id' || chr(9) || '[zh] user_id|' || {NL} ||
  '| --- | ---: |' || {NL} || '|' || event_type || chr(9) || '[zh] ' || event_type || '|' ||
  CAST(user_id AS VARCHAR) || chr(9) || '[zh] ' || CAST(user_id AS VARCHAR) || '|' || {NL} || {NL} ||
  '```json' || {NL} || props || {NL} || '```' || {NL} || {NL} || 'Event ' || CAST(event_id AS VARCHAR) ||
  {NL} || {NL} || '[zh] Event ' || CAST(event_id AS VARCHAR) || {NL} AS rendered FROM events""")
def q_render_table(spark, sf):
    out = J.translate_corpus(C.sheet_corpus(spark, sf), J.JobConfig(), STUB)
    return out.select("doc_id", "rendered")


_CORPUS_SQL = f"""WITH {SEG_A},
p1 AS (SELECT doc_id, seg_no, text, length(text) + 1 <= 2000 AS ok FROM seg_a)"""


_TRANSLATED_SQL = _CORPUS_SQL + f"""
SELECT doc_id, string_agg(text || CASE WHEN ok THEN {NL} || {NL} || '[zh] ' || text ELSE '' END, {NL} || {NL}
  ORDER BY seg_no) AS rendered,
  {_status_sql('sum(CASE WHEN ok THEN 0 ELSE 1 END)', 'count(*)')} AS status
FROM p1 GROUP BY doc_id"""


@register("translate_corpus", _TRANSLATED_SQL)
def q_translate_corpus(spark, sf):
    out = J.translate_corpus(C.lines_corpus(spark, sf), J.JobConfig(), STUB)
    return out.select("doc_id", "rendered", "status")


@register("translate_lines_once", _TRANSLATED_SQL)
def q_translate_lines_once(spark, sf):
    out = J.translate_each_line_once(C.lines_corpus(spark, sf), J.JobConfig(), STUB)
    return out.select("doc_id", "rendered", "status")


@register("retranslate", _CORPUS_SQL + f""",
p2 AS (SELECT doc_id, seg_no * 2 AS k, text FROM p1 UNION ALL SELECT doc_id, seg_no * 2 + 1, '[zh] ' || text FROM p1 WHERE ok),
p2o AS (SELECT *, length(text) + 1 <= 2000 AS ok FROM p2)
SELECT doc_id, string_agg(text || CASE WHEN ok THEN {NL} || {NL} || '[zh] ' || text ELSE '' END, {NL} || {NL}
  ORDER BY k) AS rendered,
  {_status_sql('sum(CASE WHEN ok THEN 0 ELSE 1 END)', 'count(*)')} AS status
FROM p2o GROUP BY doc_id""")
def q_retranslate(spark, sf):
    out = J.retranslate(C.lines_corpus(spark, sf), J.JobConfig(), STUB)
    return out.select("doc_id", "rendered", "status")


# --- code comments and HTML ---------------------------------------------
from interlinear.operators import comments as CM  # noqa: E402
from interlinear.operators import html as H  # noqa: E402

_SNIP = f"""sn AS (SELECT s_suppkey AS doc_id, s_name, s_nationkey,
  '//! ' || s_name || ' module' AS c0,
  '// nation ' || CAST(s_nationkey AS VARCHAR) AS c1,
  '/* key ' || CAST(s_suppkey AS VARCHAR) || ' */' AS c2,
  'fn balance() -> i64 {{' AS l1,
  '    let x = "http://example.com/' || CAST(s_suppkey AS VARCHAR) || '"; ' AS l3a FROM supplier),
snc AS (SELECT *, c0 || {NL} || l1 || {NL} || '    ' || c1 || {NL} || l3a || c2 || {NL} || '    x' || {NL} || '}}' || {NL} AS code
  FROM sn)"""


@register("code_blocks", f"""WITH {_SNIP}
SELECT doc_id, 0 AS block_no, 'rust' AS lang, code FROM snc""")
def q_code_blocks(spark, sf):
    return CM.code_blocks(C.code_corpus(spark, sf))


@register("code_comments", f"""WITH {_SNIP},
o AS (SELECT *, strlen(c0) + 1 + strlen(l1) + 1 + 4 AS f1,
        strlen(c0) + 1 + strlen(l1) + 1 + 4 + strlen(c1) + 1 + strlen(l3a) AS f2 FROM snc)
SELECT doc_id, 0 AS block_no, 0 AS idx, CAST(0 AS BIGINT) AS "from", CAST(strlen(c0) AS BIGINT) AS "to",
       '! ' || s_name || ' module' AS comment FROM o
UNION ALL SELECT doc_id, 0, 1, CAST(f1 AS BIGINT), CAST(f1 + strlen(c1) AS BIGINT),
       'nation ' || CAST(s_nationkey AS VARCHAR) FROM o
UNION ALL SELECT doc_id, 0, 2, CAST(f2 AS BIGINT), CAST(f2 + strlen(c2) AS BIGINT),
       '* key ' || CAST(doc_id AS VARCHAR) || ' */' FROM o""")
def q_code_comments(spark, sf):
    return CM.code_comments(CM.code_blocks(C.code_corpus(spark, sf))).select(
        "doc_id", "block_no", F.col("idx").cast("int").alias("idx"), "from", "to", "comment")


def _comment_translations(spark, sf):
    blocks = CM.code_blocks(C.code_corpus(spark, sf))
    tr = CM.code_comments(blocks).select("doc_id", "block_no", "idx", stub.stub_line(F.col("comment")).alias("translation"))
    return blocks, tr


@register("insert_comment_translations", f"""WITH {_SNIP}
SELECT doc_id, 0 AS block_no, 'rust' AS lang,
  c0 || {NL} || '// [zh] ! ' || s_name || ' module' || {NL} || l1 || {NL} || '    ' || c1 || {NL} ||
  '// [zh] nation ' || CAST(s_nationkey AS VARCHAR) || {NL} || l3a || c2 || {NL} ||
  '// [zh] * key ' || CAST(doc_id AS VARCHAR) || ' */' || {NL} || '    x' || {NL} || '}}' || {NL} AS code_out FROM snc""")
def q_insert_comment_translations(spark, sf):
    blocks, tr = _comment_translations(spark, sf)
    return CM.insert_comment_translations(blocks, tr)


def _ent_sql(x: str) -> str:
    """The references that the pages hold, the ampersand's last."""
    for name, value in (("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{value}')"
    return x


@register("html_inner_text", "SELECT page_id, trim(regexp_replace(" + _ent_sql(
    "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
    "'(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')")
    + ", '\\s+', ' ', 'g')) AS text FROM pages")
def q_html_inner_text(spark, sf):
    from interlinear.sources.tables import load
    return H.html_inner_text(load(spark, sf, "pages"))


# a paragraph of these pages runs to the next <p>, </p> or </article>
@register("html_tag_text", "SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, " + _ent_sql(
    "regexp_replace(regexp_replace(raw, '(?s)(</p>|</article>).*$', ''), '<[^>]*>', '', 'g')") + """ AS text FROM (
  SELECT page_id, unnest(m) AS raw, unnest(range(1, len(m) + 1)) AS pos FROM (
    SELECT page_id, string_split(html, '<p>')[2:] AS m FROM pages))""")
def q_html_tag_text(spark, sf):
    from interlinear.sources.tables import load
    return H.html_tag_text(load(spark, sf, "pages"), "p")


@register("html_made_text", """SELECT s_suppkey AS page_id, s_name || ' x bold' || CAST(s_nationkey AS VARCHAR) ||
  ' it\u2019s ' || s_name || ' end' AS text FROM supplier""")
def q_html_made_text(spark, sf):
    return H.html_inner_text(C.html_corpus(spark, sf), keep_style=False)


@register("html_made_elements", """SELECT s_suppkey AS page_id, CAST(pos AS INTEGER) AS pos, CASE pos
  WHEN 0 THEN 'x bold' || CAST(s_nationkey AS VARCHAR) || 'it\u2019s ' || s_name
  WHEN 1 THEN s_name ELSE 'end' END AS text FROM supplier, (VALUES (0), (1), (2)) v(pos)""")
def q_html_made_elements(spark, sf):
    return H.html_tag_text(C.html_corpus(spark, sf), "div")


# --- sources, planning and sinks -----------------------------------------
from interlinear.operators import planning as O  # noqa: E402
from interlinear.sources import files as S  # noqa: E402
from interlinear.sources.tables import load as _load  # noqa: E402


def _doc_paths(spark, sf):
    d = _load(spark, sf, "documents").select("doc_id", "source")
    return d.select(
        "doc_id",
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("/corpus/"), "source", F.lit(".d/"), F.col("doc_id").cast("string")).alias("bare_path"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/")).alias("dir"),
        F.concat(F.lit("/corpus/"), "source", F.lit(".v1")).alias("dotted_dir"),
        F.lit("zh").alias("to_lang"))


@register("output_paths", """SELECT doc_id,
  '/corpus/' || source || '/' || CAST(doc_id AS VARCHAR) || '-zh.md' AS out_path,
  '/corpus/' || source || '.d/' || CAST(doc_id AS VARCHAR) || '-zh' AS out_bare,
  '/corpus/' || source || '-zh' AS out_dir,
  '/corpus/' || source || '-zh' AS out_dotted_dir,
  '/corpus/' || source || '-zh/' || CAST(doc_id AS VARCHAR) || '.md' AS dir_out FROM documents""")
def q_output_paths(spark, sf):
    p = _doc_paths(spark, sf)
    return p.select(
        "doc_id",
        O.output_file_path("path", "to_lang").alias("out_path"),
        O.output_file_path("bare_path", "to_lang").alias("out_bare"),
        O.output_dir_path("dir", "to_lang").alias("out_dir"),
        O.output_dir_path("dotted_dir", "to_lang").alias("out_dotted_dir"),
        O.dir_output_path(O.output_dir_path("dir", "to_lang"), "path").alias("dir_out"))


@register("pair_inputs_outputs", """SELECT coalesce(d.doc_id, l.doc_id) AS ordinal,
  '/corpus/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.md' AS path,
  '/out/' || CAST(l.doc_id AS VARCHAR) || '.md' AS out_path,
  CASE WHEN d.doc_id IS NULL OR l.doc_id IS NULL THEN 'count_mismatch' ELSE 'paired' END AS status
FROM documents d FULL OUTER JOIN labels l ON l.doc_id = d.doc_id""")
def q_pair_inputs_outputs(spark, sf):
    ins = _doc_paths(spark, sf).select(F.col("doc_id").alias("ordinal"), "path")
    outs = _load(spark, sf, "labels").select(
        F.col("doc_id").alias("ordinal"), F.concat(F.lit("/out/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("out_path"))
    return O.pair_inputs_outputs(ins, outs).select("ordinal", "path", "out_path", "status")


@register("skip_existing", """SELECT d.doc_id, '/corpus/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) || '-zh.md' AS out_path,
  CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'skip' ELSE 'todo' END AS status FROM documents d""")
def q_skip_existing(spark, sf):
    work = _doc_paths(spark, sf).select("doc_id", O.output_file_path("path", "to_lang").alias("out_path"))
    # outputs already on disk: the labelled documents were translated before
    existing = _load(spark, sf, "labels").join(_doc_paths(spark, sf).hint("merge"), "doc_id").select(
        O.output_file_path("path", "to_lang").alias("path"))
    return O.mark_existing(work, existing).select("doc_id", "out_path", "status")


@register("inline_docs", f"""SELECT conv_id AS request_id, string_agg(text, {NL} || {NL} ORDER BY turn) AS content,
  'query' AS doc_kind FROM conversations GROUP BY conv_id""")
def q_inline_docs(spark, sf):
    c = _load(spark, sf, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("pos"), "text")
    return S.inline_docs(c)


@register("read_files")
def q_read_files(spark, sf):
    """Rows-only: every driver table file read as one raw document; parquet
    bytes are not UTF-8, so each is reported ``invalid_utf8``."""
    import glob
    import os
    paths = sorted(glob.glob(os.path.join(sf, "*.parquet")))
    return S.read_files(spark, paths).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "doc_kind", "status", "n_bytes")


# --- line classification, HTML blocks, work list -------------------------
from interlinear.operators.blocks import block_lines as _block_lines  # noqa: E402


@register("block_lines", """SELECT event_id AS doc_id, CAST(line_no AS INTEGER) AS line_no, kind FROM events,
  (VALUES (0, 'table_head'), (1, 'table_delim'), (2, 'table_row'), (3, 'blank'), (4, 'fence'), (5, 'code'),
          (6, 'fence'), (7, 'blank'), (8, 'text'), (9, 'blank')) AS k(line_no, kind)""")
def q_block_lines(spark, sf):
    return _block_lines(C.sheet_corpus(spark, sf)).select("doc_id", "line_no", "kind")


@register("html_blocks_dropped", """SELECT doc_id, 0 AS seg_no, 'Document ' || CAST(doc_id AS VARCHAR) AS text,
  CAST(5 AS INTEGER) AS block_no FROM labels""")
def q_html_blocks_dropped(spark, sf):
    return M.extract_segments(C.html_block_corpus(spark, sf)).select("doc_id", "seg_no", "text", "block_no")


@register("work_list", """SELECT doc_kind, count(*) AS n_docs, sum(strlen(content)) AS n_bytes FROM (
  SELECT 'query' AS doc_kind, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id
  UNION ALL SELECT 'table', text FROM documents) GROUP BY doc_kind""")
def q_work_list(spark, sf):
    inline = S.inline_docs(_load(spark, sf, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("pos"), "text"))
    table = _load(spark, sf, "documents").select(F.lit("table").alias("doc_kind"), F.col("text").alias("content"))
    wl = S.work_list(inline, table)
    return wl.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n_docs"),
                                      F.sum(F.octet_length("content")).alias("n_bytes"))
