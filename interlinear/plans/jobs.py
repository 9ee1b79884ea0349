"""The end-to-end translation job as one Spark plan.

documents -> segments -> greedy batches (provider limit) -> signed requests
-> translator -> parsed responses -> aligned segments -> rendered documents,
with a per-document status instead of stopping the run on the first failure.

Each batch row carries its segments, so with keyed alignment the responses
are aligned inside the batch row and the whole job is one pipeline. Only
positional alignment or a user translator reuses the batches; they are then
materialised once: ``checkpoint()`` into the shared ``spark.checkpoint.dir``
(reliable, survives executor loss, cuts the lineage), or ``persist``.
Nothing passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlinear import dims
from interlinear.functions.text import utrim
from interlinear.operators import align as A
from interlinear.operators import batching as B
from interlinear.operators import requests as R
from interlinear.operators import responses as P
from interlinear.operators import translate as T
from interlinear.operators.render import assemble, item_sql, render
from interlinear.operators.segments import document_segments
from interlinear.operators.blocks import distribute_docs
from interlinear.session import checkpoint_dir, use_document_partitioning


@dataclass
class JobConfig:
    provider: str = "tencent"
    limit: int | None = None           # None: the provider default; 0: whole document per request
    from_lang: str = "en"
    to_lang: str = "zh"
    timestamp: int = 1636111645        # request signing time, an explicit parameter
    alignment: str = "keyed"           # or "positional" (reference behaviour)
    list_mode: str = "carry"
    materialize: str = "checkpoint"    # when batches are reused: "checkpoint" | "persist" | "none"
    creds: R.Credentials = field(default_factory=lambda: R.Credentials(
        baidu=R.Md5FormUser("demo-appid", "demo-key"), tencent=R.SignedJsonUser("0", "0"),
        niutrans=R.PlainFormUser("demo-apikey")))


def _limit(cfg: JobConfig) -> tuple[str, int]:
    for p, unit, default, _ in dims.PROVIDERS:
        if p == cfg.provider:
            return unit, default if cfg.limit is None else int(cfg.limit)
    raise ValueError(f"unknown provider {cfg.provider!r}")


def materialize(df: DataFrame, how: str = "checkpoint") -> DataFrame:
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "persist":
        return df.persist()
    return df


def _answers(reqs: DataFrame, translator, key: str) -> DataFrame:
    """Requests with ``status``, ``dst`` and ``error_msg``. Only ready requests
    reach the translator; the others fail with their reason."""
    ready = reqs.filter(F.col("req_status") == "ready")
    if isinstance(translator, T.Service):
        out = P.unify_responses(translator.respond(reqs))
        bad = F.col("req_status") != "ready"
        return out.withColumn("dst", F.when(~bad, F.col("dst"))) \
            .withColumn("status", F.when(bad, F.col("req_status")).otherwise(F.col("status"))) \
            .withColumn("error_msg", F.when(bad, F.col("lang_error")).otherwise(F.col("error_msg")))
    got = T.via_table(ready, translator, key) if isinstance(translator, DataFrame) else T.via_function(ready, translator, key)
    got = got.select(key, "batch_no", F.col("status").alias("__s"), "dst", F.col("error_msg").alias("__m"))
    out = reqs.select(key, "batch_no", "segs", "req_status", "lang_error").join(got.hint("merge"), [key, "batch_no"], "left")
    return out.withColumn("status", F.coalesce("__s", "req_status")).withColumn("error_msg", F.coalesce("__m", "lang_error")) \
        .drop("__s", "__m")


def translate_corpus(docs: DataFrame, cfg: JobConfig | None = None, translator=None,
                     key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, rendered, n_segments, n_failed, status, reason)`` per document.

    ``translator`` (required): a DataFrame ``(from_lang, to_lang, src, dst)`` ->
    translation-memory join; a callable ``(lines, from, to) -> lines`` -> run
    per request in ``mapInPandas``; a ``translate.Service`` -> JSON responses.

    Requests that their provider's rules reject are not sent; they, failed
    calls and unreadable responses leave the original text and are counted in
    ``n_failed`` with a ``reason``. With keyed alignment and a Service the plan
    is one pipeline: each batch row carries its segments. Positional alignment
    reuses the batches, which are then materialised once (``cfg.materialize``);
    the answers of a table or function are materialised too, so that no request
    is asked twice.
    """
    if translator is None:
        raise TypeError("translate_corpus needs a translator: a DataFrame, a callable or a translate.Service")
    cfg = cfg or JobConfig()
    unit, limit = _limit(cfg)
    use_document_partitioning(docs.sparkSession)
    # one distribution of the documents, read by segmentation and rendering
    docs = distribute_docs(docs.select(key, text_col), key)
    found = document_segments(docs, key, text_col, list_mode=cfg.list_mode, distribute=False)
    segs = found.select(key, F.inline("segs"))
    service = isinstance(translator, T.Service)
    if limit == 0:
        # Application-level limit 0 = the whole text as one request
        bt = B.whole_batches(segs, key).withColumn("oversize", F.lit(False))
        batched = segs.filter(~F.col("is_tail")).withColumn("batch_no", F.lit(0))
    else:
        bt = B.document_batches(found, limit, unit, key)
        batched = None
        if cfg.alignment == "positional":  # needs the segments again: every segment with its batch
            batched = materialize(B.assign_batches(B.with_limit(segs, limit, unit), key), cfg.materialize)
            bt = B.batch_text(batched, key)
        elif not service:  # read by the translator and again with its answers
            bt = materialize(bt, cfg.materialize)
    bt = bt.withColumn("provider", F.lit(cfg.provider)) \
           .withColumn("from_lang", F.lit(cfg.from_lang)).withColumn("to_lang", F.lit(cfg.to_lang))
    resp = _answers(R.build_requests(bt, cfg.creds, cfg.timestamp), translator, key)
    if not service:
        resp = materialize(resp, cfg.materialize)
    # a partial answer keeps the lines it has; only failed batches lose theirs
    usable = F.col("status").isin("ok", "partial")
    if cfg.alignment == "positional":
        lines = resp.filter(usable).select(key, "batch_no", F.posexplode("dst").alias("pos", "line"))
        aligned = A.align_positional(batched.withColumn("is_tail", F.lit(False)), T.number_lines(lines, key), key)
        return render(docs, aligned, key, text_col, distribute=False)
    # status comes out of the renderer's own step (segments whose batch failed),
    # so the responses are consumed once
    gathered = A.gather_in_batches(resp.withColumn("dst", F.when(usable, F.col("dst")))
                                   .withColumn("reason", F.when(~usable, F.coalesce("error_msg", "status"))), key)
    return assemble(docs, gathered, key, text_col, distribute=False)


GROUP_LINES = 10_000  # distinct lines that are planned into requests together
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Kept:
    """A step's rows, made once, and dropped when the later steps have read them:
    compressed files in the shared folder, or what else ``materialize`` says."""

    def __init__(self, df: DataFrame, how: str):
        spark = df.sparkSession
        self.rows, self.path = df, None
        if how == "checkpoint":
            self.path = f"{checkpoint_dir(spark).rstrip('/')}/interlinear-lines-{uuid.uuid4().hex}"
            with _shuffles_removed(spark):
                df.write.option("compression", "zstd").parquet(self.path)
            self.rows = spark.read.schema(df.schema).parquet(self.path)
        elif how == "persist":
            self.rows = df.persist()

    def count(self, *cols) -> int:
        """Number of distinct values that are not null."""
        with _shuffles_removed(self.rows.sparkSession):
            return self.rows.select(*cols).dropna().distinct().count()

    def drop(self) -> None:
        spark = self.rows.sparkSession
        if self.path:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when a query ends, not when the
    driver happens to collect its garbage."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def _line_id(text: str):
    """16 bytes of a line's SHA-256: what stands for the line where its text is not needed."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def translate_each_line_once(docs: DataFrame, cfg: JobConfig | None = None, translator=None,
                             key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A12 with every distinct line of the corpus asked once: the same result
    columns as ``translate_corpus``.

    The distinct segment texts (partially aggregated before their shuffle) are
    dealt by hash to groups of about ``GROUP_LINES``, a group is batched like a
    document under the provider's limit, and the answers are joined back to every
    place of their line; a line that fills many places is split by adaptive
    execution. A failed request fails its lines wherever they stand. Needs a
    limit above 0 and keyed alignment: requests do not follow documents here.

    A text is on disk in few copies at a time: segments, answers and translated
    places are written compressed, each is dropped when the next is made, and
    places meet answers by ``_line_id``, without the text.
    """
    if translator is None:
        raise TypeError("translate_each_line_once needs a translator: a DataFrame, a callable or a translate.Service")
    cfg = cfg or JobConfig()
    unit, limit = _limit(cfg)
    if limit == 0 or cfg.alignment != "keyed":
        raise ValueError("each line once needs a limit above 0 and keyed alignment")
    use_document_partitioning(docs.sparkSession)
    docs = distribute_docs(docs.select(key, text_col), key)
    found = document_segments(docs, key, text_col, list_mode=cfg.list_mode, distribute=False)
    segs = found.select(F.col(key).alias("__key"), F.inline("segs")).filter("not is_tail").drop("is_tail", "n_bytes", "n_chars")
    segs = _Kept(segs.withColumn("line", F.when(utrim("text") != "", _line_id("text"))), cfg.materialize)
    groups = max(1, -(-segs.count("line") // GROUP_LINES))
    lines = segs.rows.filter("line is not null").groupBy(F.pmod(F.xxhash64("text"), F.lit(groups)).alias(key)) \
        .agg(F.array_sort(F.collect_set("text")).alias("lines"))
    lines = lines.selectExpr(f"`{key}`", "transform(lines, (x, i) -> named_struct('seg_no', i, 'text', x, 'n_bytes',"
                             " cast(octet_length(x) + 1 as bigint), 'n_chars', cast(char_length(x) + 1 as bigint))) as segs")
    bt = B.document_batches(lines, limit, unit, key).withColumn("provider", F.lit(cfg.provider)) \
        .withColumn("from_lang", F.lit(cfg.from_lang)).withColumn("to_lang", F.lit(cfg.to_lang))
    # other translators read the batches and meet them again with their answers
    asked = _Kept(bt, "none" if isinstance(translator, T.Service) else cfg.materialize)
    resp = _answers(R.build_requests(asked.rows, cfg.creds, cfg.timestamp), translator, key)
    usable = F.col("status").isin("ok", "partial")
    known = A.align_in_batches(resp.withColumn("dst", F.when(usable, F.col("dst")))
                               .withColumn("reason", F.when(~usable, F.coalesce("error_msg", "status"))), key)
    known = _Kept(known.select(_line_id("text").alias("line"), "translation", "batch_ok", "reason"), cfg.materialize)
    asked.drop()
    places = _Kept(segs.rows.drop("text"), cfg.materialize)
    segs.drop()
    met = places.rows.join(known.rows.hint("merge"), "line", "left")
    met = _Kept(met.select(F.col("__key").alias(key), F.expr(item_sql(ok="coalesce(batch_ok, true)")).alias("item")), cfg.materialize)
    places.drop()
    known.drop()
    gathered = met.rows.groupBy(key).agg(F.collect_list("item").alias("items"))
    return assemble(docs, gathered, key, text_col, distribute=False)


def retranslate(docs: DataFrame, cfg: JobConfig | None = None, translator=None,
                key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run the job on its own output (original, translation, and the
    translation of both). The first pass is materialised: the second reads its
    documents twice and must not translate them again."""
    first = translate_corpus(docs, cfg, translator, key, text_col)
    again = materialize(first.select(key, F.col("rendered").alias(text_col)), (cfg or JobConfig()).materialize)
    return translate_corpus(again, cfg, translator, key, text_col)
