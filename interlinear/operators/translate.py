"""The pluggable translate step: request lines in, one response per request.

Interchangeable translators:

(a) ``via_table``: left join of the request lines with a translations table
    ``(from_lang, to_lang, src, dst)`` -- a memory of earlier translations;
(b) ``via_function``: a user function ``list[str] -> list[str]`` applied per
    request inside ``mapInPandas`` (the place to call a real service; Spark
    parallelises and retries per partition);
(c) ``Service``: adds each provider's raw JSON response to the requests, which
    ``responses.unify_responses`` then reads.

No answer stops a run: an exception of the user function is that request's
``error`` status with its message, an answer with another number of lines than
the request is ``partial``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Service:
    """A translator that answers whole requests: ``respond(requests)`` adds the
    provider's JSON response as column ``body``."""

    respond: Callable[[DataFrame], DataFrame]


def via_table(reqs: DataFrame, translations: DataFrame, key: str = "doc_id") -> DataFrame:
    """(a) translate each request line by equi-join with a translations table.

    Lines without a known translation stay null; the response keeps line
    order (``pos``) and is re-assembled per request by a grouped collect
    bounded by the request's own size (itself bounded by the provider limit).
    """
    lines = reqs.select(key, "batch_no", "provider", "from_lang", "to_lang",
                        F.posexplode("lines").alias("pos", "src"))
    # several translations of one line: the smallest, whatever the row order
    t = translations.groupBy("from_lang", "to_lang", "src").agg(F.min("dst").alias("dst"))
    j = lines.join(t.hint("merge"), ["from_lang", "to_lang", "src"], "left")
    g = j.groupBy(key, "batch_no", "provider").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("p"))
    return g.select(key, "batch_no", "provider", F.transform("p", lambda x: x["dst"]).alias("dst"),
                    F.when(F.exists("p", lambda x: x["dst"].isNull()), F.lit("partial")).otherwise(F.lit("ok")).alias("status"),
                    F.lit(None).cast("string").alias("error_msg"))


def via_function(reqs: DataFrame, fn: Callable[[list[str], str, str], list[str]], key: str = "doc_id") -> DataFrame:
    """(b) user translator called once per request through ``mapInPandas``.

    ``fn(lines, from_lang, to_lang) -> lines``. Arrow batches move the
    requests to Python workers; a failed task is retried by Spark, and the
    requests of a partition run one after the other, as a rate-limited
    service needs.
    """
    cols = [key, "batch_no", "provider", "from_lang", "to_lang", "lines"]
    key_type = reqs.schema[key].dataType.simpleString()

    def answer(lines, from_lang, to_lang):
        try:
            got = [None if x is None else str(x) for x in fn(list(lines), from_lang, to_lang)]
        except Exception as e:  # a failed call is this request's status, not the end of the run
            return None, "error", f"{type(e).__name__}: {e}"
        if len(got) != len(lines):
            return got, "partial", f"{len(lines)} lines asked, {len(got)} returned"
        return got, "ok", None

    def run(batches):
        for pdf in batches:
            out = [answer(ls, f, t) for ls, f, t in zip(pdf["lines"], pdf["from_lang"], pdf["to_lang"])]
            yield pd.DataFrame({key: pdf[key], "batch_no": pdf["batch_no"], "provider": pdf["provider"],
                                **{c: [o[n] for o in out] for n, c in enumerate(("dst", "status", "error_msg"))}})

    schema = f"{key} {key_type}, batch_no int, provider string, dst array<string>, status string, error_msg string"
    return reqs.select(*cols).mapInPandas(run, schema)


def number_lines(resp: DataFrame, key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("batch_no", "pos")
    return resp.withColumn("line_no", (F.row_number().over(w) - 1).cast("int"))
