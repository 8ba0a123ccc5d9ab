import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    def make(texts, **more):
        rows = [(i, t, "en", "s0", None if t is None else len(t)) for i, t in (
            texts.items() if isinstance(texts, dict) else enumerate(texts))]
        return spark.createDataFrame(rows, DOCS)
    return make


@pytest.fixture()
def clashing():
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        for name in ("id", "sub", "body", "row", "found", "words", "size", "key", "node", "spans", "bucket", "n_words"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("x"))
        return df
    return add
