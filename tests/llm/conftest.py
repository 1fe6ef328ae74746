import pytest

TEXTS = [
    "The quick brown fox jumps over the lazy dog again and again until night falls on us all",
    "",
    None,
    "   \n\t ",
    "word",
    "The quick brown fox jumps over the lazy dog again and again until night falls on us all",
    "a" * 3000,
    "é ß 日本語 🎉 it's I'LL \x1c\x85\xa0x  two   spaces\n\n<|endoftext|> end\n",
    " ".join(f"w{i}" for i in range(2500)),
    "x y z",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, columns with names that results use."""
    rows = [(i * 3, t, "n", 5, "s") for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    rows.append((None, "nobody's text with some words in it", None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, score string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
