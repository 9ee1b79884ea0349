"""Small tables that the tests are written over."""


def docs(spark, *texts, key="doc_id"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"{key} long, text string")
