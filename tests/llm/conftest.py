import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents out of texts; ids count from 0 unless given."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


#: Null, empty, blank, odd white space, one word, repeats and a long text.
HARD = [None, "", " \n\t ", "one", "one", "a\tb\vc\fd\re f", "ñandú 漢字 😀 é", "word " * 3000, "x" * 20000, "l1 a b c\n\nl1 a b c\n" * 3]


@pytest.fixture
def hard():
    return list(HARD)
