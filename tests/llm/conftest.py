import pytest


@pytest.fixture
def documents(spark):
    """Builds a documents table; columns that operators use themselves stand beside the given ones."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(*r, None, None, None)[:5] if len(r) < 5 else r for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            for name in ("d", "th", "key", "keep", "lines", "entities", "both", "n_lines", "kind", "h"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
