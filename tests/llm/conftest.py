import pytest

TEXTS = {
    "null": None,
    "empty": "",
    "blank": " \t\n ",
    "short": "One two",
    "long": " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000)),
    "unsplit": "abcdefgh" * 3000,
    "odd": "Ünï cödé \u0085 x\x1cy <|endoftext|> 'S İstanbul ΣΑΣ ﬁ \U0001f600",
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, key string, body string"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", None, 1, 2, "k", "b") for i, t in enumerate(TEXTS.values())]
    # A repeated row, a null id, and one with nothing but nulls.
    return [*rows, rows[4], (None, "One two", "de", "t", 7, None, None, None, None), (None, *[None] * 8)]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """Odd texts in rows that have more columns, some named as operators name theirs."""
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
