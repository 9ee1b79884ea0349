"""Test data: a deterministic translation service for the registered queries.

Answers in each provider's JSON shape (``'[zh] ' + line``) and rejects
requests over the provider limit with that provider's "too long" error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Each provider's "request text too long" error.
TOO_LONG = {
    "baidu": ("54005", "long query request too frequent"),
    "tencent": ("UnsupportedOperation.TextTooLong", "text too long"),
    "niutrans": ("10003", "request text too long"),
}


def stub_line(c):
    return F.concat(F.lit("[zh] "), c)


def stub_service(reqs: DataFrame, too_long_col: str = "oversize") -> DataFrame:
    """(c) response ``body`` per request, in the provider's own JSON shape."""
    p = F.col("provider")
    dst = F.transform("lines", stub_line)
    rid = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("batch_no").cast("string"))
    ok_pairs = F.to_json(F.struct(F.col("from_lang").alias("from"), F.col("to_lang").alias("to"),
                                  F.transform("lines", lambda x: F.struct(x.alias("src"), stub_line(x).alias("dst")))
                                  .alias("trans_result")))
    ok_list = F.to_json(F.struct(F.struct(rid.alias("RequestId"), F.col("from_lang").alias("Source"),
                                          F.col("to_lang").alias("Target"), dst.alias("TargetTextList")).alias("Response")))
    ok_text = F.to_json(F.struct(F.concat(F.array_join(dst, "\n"), F.lit("\n")).alias("tgt_text"),
                                 F.col("to_lang").alias("to"), F.col("from_lang").alias("from")))
    err_pairs = F.to_json(F.struct(F.lit(TOO_LONG["baidu"][0]).alias("error_code"),
                                   F.lit(TOO_LONG["baidu"][1]).alias("error_msg")))
    err_list = F.to_json(F.struct(F.struct(
        F.struct(F.lit(TOO_LONG["tencent"][0]).alias("Code"), F.lit(TOO_LONG["tencent"][1]).alias("Message")).alias("Error"),
        rid.alias("RequestId")).alias("Response")))
    err_text = F.to_json(F.struct(F.col("to_lang").alias("to"), F.lit(TOO_LONG["niutrans"][0]).alias("error_code"),
                                  F.col("from_lang").alias("from"), F.lit(TOO_LONG["niutrans"][1]).alias("error_msg"),
                                  F.col("q").alias("src_text"), F.lit("xx").alias("apikey")))
    bad = F.col(too_long_col)
    body = (F.when(p == "baidu", F.when(bad, err_pairs).otherwise(ok_pairs))
            .when(p == "tencent", F.when(bad, err_list).otherwise(ok_list))
            .when(p == "niutrans", F.when(bad, err_text).otherwise(ok_text)))
    return reqs.withColumn("body", body)
