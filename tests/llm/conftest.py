import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, part int, band long, kept boolean, component_id long, score double"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in each column, empty, blank and long texts, ties, repeated rows and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog while seven small birds sing in old trees near Ärger river 12 km away. "
    other = "quite another text about nothing in particular, written so that it shares no words of five in a row with it at all. "
    long = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    texts = [base, base, base + "one more", other, "", "   \n\t", None, "a", "x" * 5_000, long, other + base, "12 34 !!", base.upper(), long + " end", "é" * 60]
    rows = [(k, t, ("en", "fr", None)[k % 3], "s", None, 1, 2, 3, True, 9, 0.5) for k, t in enumerate(texts)]
    rows += [rows[3], (None, base, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
