import public_tokenizers
import pytest
from pyspark.sql import functions as F

from callrisk.sources.tables import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def vocab():
    return public_tokenizers.path


@pytest.fixture(scope="session")
def documents(spark):
    return read_table(spark, SF, "documents").cache()


EDGE = [None, "", " ", "\n", "a", "The cat sat on the mat", "The cat sat on the mat", "the cat sat on the mat\n\n",
        "don't we'll they're 'tis ''  　x  y\t\tz <|endoftext|> and <|startoftext|>!", "ΑΣ İ ﬁ é 中文字 🙂🙂 \x1c\x85 Ⅷ²",
        "a" * 30_000, "=-" * 20_000, "word " * 20_000, "é" * 5000 + "\n" + "é" * 5000, "0123456789 " * 3,
        "one two three four five six seven eight nine ten eleven"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, very long, tied and repeated texts, a null id, and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(EDGE)] + [(5, EDGE[5]), (None, EDGE[15])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("id", "n_tokens", "fp", "bucket", "shard", "ids", "start", "n_lines", "score", "label", "a", "b"):
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
