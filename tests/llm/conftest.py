import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls in every column, empty texts, ties, repeated rows, and columns named like working columns."""
    rows = [
        (1, "One two three four five six seven.", "en", "b"), (2, "ONE two three four five six seven.", "en", None),
        (3, None, None, "b"), (4, "", "en", "a"), (5, " \t\n ", "de", "a"), (None, "Alone without an id.", "en", "a"),
        (6, "One two three four five six seven.", "en", "b"), (6, "One two three four five six seven.", "en", "b"),
        (7, "word " * 30_000, "en", "a"), (8, "x" * 60_000, None, "c"), (9, "Ünïcode 😀 text here ÄÖ", "de", "c"),
        (10, "1234 5678 !!", "fr", "c"),
    ]
    return spark.createDataFrame([Row(doc_id=i, text=t, lang=l, source=s, n_chars=0, keep_id="k", _salt=1, n=2, fp=3,
                                      bucket=4, score=0.5, tokens="t", role="r",
                                      row=1, of=2, maybe=True, id_="i", of_="o", mark=3, runs=4, _sha="s", _only_id=5,
                                      _near_text="n", text_sha256="t", stays=False) for i, t, l, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, keep_id string, "
                                 "_salt int, n int, fp int, bucket int, score double, tokens string, role string, "
                                 "row int, of int, maybe boolean, id_ string, of_ string, mark int, runs int, _sha string, "
                                 "_only_id int, _near_text string, text_sha256 string, stays boolean")
