"""The training-data pipeline over ``documents``, stage by stage.

Each stage works on all that its predecessor kept and takes effect:

1. quality classifier: documents it rejects go;
2. SimHash near duplicates: the document with the smallest id of each group
   stays (a null id comes last, equal ids by row);
3. benchmark decontamination: contaminated documents go, others stay whole;
4. personal data: mentions are replaced by surrogates;
5. packing: sequences of at most 2048 tokens, one row per piece.

``run`` writes every stage to the shared scratch folder and reads it again, so
a lost executor costs no earlier stage. Stages 1 to 4 return the columns of
``documents`` (plus any further columns their input has).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlinear.llm import cotraining, decontamination, packing, simhash, surrogates
from interlinear.llm.common import materialize, numbered, read
from interlinear.llm.queries import SURROGATE_KEY


def _own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., so that no added column can clash."""
    own = {c: f"c{n}" for n, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, own = _own_names(docs)
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    scored = cotraining.score(rows, labels, id_col=own["doc_id"], text_col=own["text"],
                              meta_cols=tuple(own.get(c, c) for c in ("source", "lang", "n_chars")))
    return scored.where("keep").select(*own.values()).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, own = _own_names(docs)
    rows, key = numbered(rows, "deduplicate"), own["doc_id"]
    groups = simhash.near_duplicates(rows, shingle=3, id_col="row", text_col=own["text"]).select(F.col("id").alias("row"), "component")
    first = F.min(F.struct(F.col(key).isNull().alias("late"), F.col(key).alias("key"), "row"))
    kept = groups.join(rows.select("row", key), "row").groupBy("component").agg(first.alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*own.values()).toDF(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark", "item_id", "text")
    return decontamination.drop_contaminated(docs, items)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, own = _own_names(docs)
    return surrogates.pseudonymize(rows, SURROGATE_KEY, own["text"]).select(*own.values()).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1).drop("ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("personal_data", personal_data), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
