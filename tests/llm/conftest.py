import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def rows(spark):
    """Documents from texts, with their place as id; extra columns bear the operators' own names."""

    def make(texts, langs=None, extra=True):
        langs = langs or ["en"] * len(texts)
        data = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(zip(texts, langs))]
        df = spark.createDataFrame(data, DOCS)
        if extra:
            for name in ("id", "rep", "dropped", "n_lines", "lines", "row", "gone", "score", "y", "x", "v", "n", "component_id", "piece", "word"):
                df = df.selectExpr("*", f"'other' AS {name}")
        return df

    return make
