import pytest

EXTRA = {"fp": 1, "_b": "x", "component_id": 2, "h": 3, "key": 4, "count": 5, "host": "z", "_tag": 6, "node": 7}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, _b string, component_id int, h int, key int, count int, host string, _tag int, node int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) or (doc_id, text, lang) as documents, with extra columns whose names clash with the operators' own."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] is not None else None, *EXTRA.values()) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, a null id, a very long text, ties and repeated rows."""
    long = "lorem ipsum dolor sit amet " * 8000
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one two three four five six seven eight nine ten eleven"), (4, "one two three four five six seven eight nine ten eleven"), (5, "one two three four five six seven eight nine ten eleven"), (None, "one two three four five six seven eight nine ten eleven"), (6, long), (7, "Ünïcödé ßtraße 日本語 \U0001f642"), (8, "12345 !!! ###"), (9, "a")]
