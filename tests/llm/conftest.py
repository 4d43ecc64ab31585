import pytest

from uas_spark.llm.common import prepare

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and water mountain river stone cloud forest winter summer garden letter window bridge".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n))


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text, lang); with clashing extra columns on request."""
    prepare(spark)

    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if clash:
            for name in ("id", "t", "fp", "h", "n", "row", "label", "term", "base", "keep", "score", "piece", "rank"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make


@pytest.fixture
def odd_rows():
    """Null and empty texts, blanks only, a long text, repeated rows, null ids and languages."""
    long = " ".join(f"word{i % 977} river" for i in range(30000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "a quiet river by the old stone bridge"),
            (5, "a quiet river by the old stone bridge"), (6, "a quiet river by the old stone bridge", None),
            (None, "the winter garden and the summer garden"), (None, None, None), (7, "Ünïcödé 日本語 𝒳 <|endoftext|> é"),
            (8, "12345 67890 !!!"), (9, "one")]
