import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of the input.
CLASHES = ("id", "t", "t1", "t2", "k1", "h", "m", "q", "row", "size", "node", "rid", "position", "_text", "kept")


@pytest.fixture(scope="session")
def make_docs(spark):
    """make_docs([(doc_id, text), ...]) -> documents with clashing extra columns."""
    def make(rows, lang="en", source="s", clashes=True):
        from pyspark.sql import functions as F

        full = [(i, t, lang, source, len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df
    return make


def prose(seed, n, vocabulary=4000):
    """n words that look like text, the same for the same seed."""
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank, short, very long and repeated texts, ties and repeated rows."""
    long_text = prose(1, 60_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, long_text), (7, long_text),
            (8, prose(2, 300)), (8, prose(2, 300)), (9, "same " * 500), (None, prose(2, 300)), (None, None),
            (10, prose(3, 300)), (11, prose(3, 290) + " new tail"), (12, "ÉTÉ été  x y")]
