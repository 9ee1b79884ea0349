"""Parse provider responses, explain errors, flatten translated lines.

Bodies are decoded with ``from_json`` against one merged nullable schema per
provider (success fields and error fields side by side). As in the services'
clients, the success shape wins when its fields are present; a body that is
not JSON, or has neither shape, is ``bad_json``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interlinear import dims
from interlinear.functions.text import utrim_end

PAIRS_SCHEMA = ("struct<from:string,to:string,trans_result:array<struct<src:string,dst:string>>,"
                "error_code:string,error_msg:string>")
LIST_SCHEMA = ("struct<Response:struct<RequestId:string,Source:string,Target:string,TargetTextList:array<string>,"
               "Error:struct<Code:string,Message:string>>>")
TEXT_SCHEMA = "struct<tgt_text:string,from:string,to:string,error_code:string,error_msg:string,apikey:string>"

RESULT_COLS = ["status", "dst", "error_code", "error_msg"]


def _found(body: str, schema: str, dst, code, msg):
    """``body`` parsed once: struct of its lines, error code and message."""
    one = lambda j: F.struct(dst(j).alias("dst"), code(j).alias("code"), msg(j).alias("msg"))
    return F.element_at(F.transform(F.array(F.from_json(F.col(body), schema)), one), 1)


def _pairs(body: str):
    return _found(body, PAIRS_SCHEMA, lambda j: F.transform(j["trans_result"], lambda x: x["dst"]),
                  lambda j: j["error_code"], lambda j: j["error_msg"])


def _list(body: str):
    return _found(body, LIST_SCHEMA, lambda j: j["Response"]["TargetTextList"],
                  lambda j: j["Response"]["Error"]["Code"], lambda j: j["Response"]["Error"]["Message"])


def _text(body: str, code):
    return _found(body, TEXT_SCHEMA, lambda j: F.when(j["tgt_text"].isNotNull(), F.split(utrim_end(j["tgt_text"]), "\n", -1)),
                  code, lambda j: j["error_msg"])


def _result(df: DataFrame, found) -> DataFrame:
    """``df`` with the result columns. They leave a generator, not a projection:
    a filter on them pushed below a projection would build and parse the body
    again for each place that it names one."""
    def one(r):
        status = (F.when(r["dst"].isNotNull(), F.lit("ok"))
                  .when(r["code"].isNotNull(), F.lit("error"))
                  .otherwise(F.lit("bad_json")))
        return F.struct(status.alias("status"), r["dst"].alias("dst"),
                        F.when(r["dst"].isNull(), r["code"]).alias("error_code"), F.when(r["dst"].isNull(), r["msg"]).alias("error_msg"))

    return df.drop(*RESULT_COLS).select("*", F.inline(F.transform(F.array(found), one)))


def parse_pairs(df: DataFrame, body: str = "body") -> DataFrame:
    """``{from,to,trans_result:[{src,dst}]}`` or ``{error_code,error_msg}``."""
    return _result(df, _pairs(body))


def parse_list(df: DataFrame, body: str = "body") -> DataFrame:
    """``Response.TargetTextList`` or ``Response.Error{Code,Message}``."""
    return _result(df, _list(body))


def parse_text(df: DataFrame, body: str = "body") -> DataFrame:
    """``tgt_text`` right-trimmed then split on newline, or the error."""
    return _result(df, _text(body, lambda j: F.when(j["apikey"].isNotNull() | j["error_msg"].isNotNull(), j["error_code"])))


def unify_responses(df: DataFrame, body: str = "body") -> DataFrame:
    """One result shape for every provider, chosen per row by ``provider``.

    All three decoders run as one CASE on the provider (no union of filtered
    branches), so responses are scanned once and each body is parsed once.
    """
    p = F.col("provider")
    return _result(df, F.when(p == "baidu", _pairs(body)).when(p == "tencent", _list(body))
                   .when(p == "niutrans", _text(body, lambda j: j["error_code"])))


def explain_error(parsed: DataFrame, codes: DataFrame) -> DataFrame:
    """P5: code -> meaning via a left join with the code table, broadcast if small;
    unknown codes read 'unknown error'."""
    c = codes.select(F.col("provider").alias("_p"), F.col("code").alias("_c"), F.col("meaning").alias("_m"))
    j = parsed.drop("meaning").join(c, (parsed["provider"] == c["_p"]) & (parsed["error_code"] == c["_c"]), "left")
    meaning = F.when(F.col("status") == "error", F.coalesce(F.col("_m"), F.lit(dims.UNKNOWN_ERROR)))
    return j.withColumn("meaning", meaning).drop("_p", "_c", "_m")


def format_error(explained: DataFrame) -> DataFrame:
    """Multi-line message: code, message, meaning, provider."""
    label = F.coalesce(F.element_at(F.create_map(*[x for kv in dims.PROVIDER_LABELS.items() for x in map(F.lit, kv)]),
                                    F.col("provider")), F.col("provider"))
    msg = F.when(F.col("status") == "error", F.concat(
        F.lit("error code: `"), F.col("error_code"), F.lit("`\nerror message: `"), F.col("error_msg"),
        F.lit("`\nmeaning: "), F.col("meaning"), F.lit("\nreturned by the "), label))
    return explained.withColumn("error_text", msg)


def response_lines(parsed: DataFrame, key: str = "doc_id", extra_keys: list[str] | None = None) -> DataFrame:
    """A document's responses flattened, in batch order, to one stream of
    lines numbered ``line_no`` (what positional alignment consumes); with
    ``extra_keys`` one stream for each of their values."""
    keys = [key, *(extra_keys or [])]
    ok = parsed.filter(F.col("status") == "ok")
    lines = ok.select(*keys, "batch_no", F.posexplode("dst").alias("pos", "line"))
    w = Window.partitionBy(*keys).orderBy("batch_no", "pos")
    return lines.withColumn("line_no", (F.row_number().over(w) - 1).cast("int"))


def error_summary(explained: DataFrame) -> DataFrame:
    """Error counts per provider, code and meaning (map-side partial
    aggregation keeps a hot code cheap)."""
    e = explained.filter(F.col("status") != "ok")
    return e.groupBy("provider", "status", "error_code", "meaning").agg(F.count(F.lit(1)).alias("n"))
