import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a long one, repeated rows, and columns whose names operators use themselves."""
    long_text = " ".join(f"w{k % 977}x{k}" for k in range(30_000)) + "\n" + "z" * 50_000
    texts = [None, "", "  \n ", "one", "one two three four five six\nseven", "one two three four five six\nseven", long_text, "9 8 7", "à é ï 日本語"]
    rows = [(k, t, None if k % 4 == 0 else "en", "s", k, "own", [1]) for k, t in enumerate(texts)]
    rows += [rows[4], (None, "one two three four five six", "en", "s", 1, "own", [1]), (99, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n long, items string, removed array<int>"
    return spark.createDataFrame(rows, schema).withColumnRenamed("n", "key")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
