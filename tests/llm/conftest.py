import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """A folder for written tables, as a cluster names one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with further columns under clashing names."""

    def make(rows, **extra):
        names = {"text": "text", "doc_id": "doc_id"} | extra
        schema = (
            f"{names['doc_id']} long, {names['text']} string, lang string, bucket int, spans string, "
            "part int, kind int, n_words int, fp long, body string, n_chars long"
        )
        filled = [(i, t, "en", 7, "x", 7, 7, 7, 7, "y", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(filled, schema)

    return make


#: Nulls in both columns, empty and blank texts, repeated rows, equal ids with unlike texts.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (None, "one two three"),
    (None, None),
    (4, "one two three"),
    (4, "one two three"),
    (5, "four five six"),
    (5, "seven eight nine"),
    (6, "é ü 日本 \U0001f600 x"),
    (7, "\\ \" ' $1 \\1 %s"),
]


@pytest.fixture
def edges(documents):
    return documents(EDGES)


@pytest.fixture
def no_rows(documents):
    return documents([])
