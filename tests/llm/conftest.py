import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents_pd():
    return pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, repeated rows and keys, one long text, and columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    copy = "a shared passage of more than thirteen words that stands in two documents and is cut from one of them"
    rows = [
        (1, copy + " one", "en", "s"), (2, copy + " two", "en", None), (2, copy + " two", "en", None), (3, None, None, "s"), (4, "", "en", "s"), (5, " \n\t ", "en", "s"), (6, "A", "de", "s"), (7, "123 !!", "en", "s"),
        (None, "null key " + copy, "en", "s"), (None, None, None, None), (8, long, "en", "s"), (9, long, "en", "s"), (10, "x" * 200_000, "en", "s"), (11, "日本語 ﬁ ▁   <|endoftext|> \x00 é", "en", "s"), (12, copy + " one", "en", "s"),
    ]
    full = [(*r, 0 if r[1] is None else len(r[1]), "clash", -1, "k") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, bucket string, k int, mark string")

