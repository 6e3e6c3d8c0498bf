import pytest

SF = "/root/testdata/sf0.001"

#: long enough to be cut, hot enough to be shared, and awkward texts
AWKWARD = [
    None,
    "",
    " \n\t ",
    "word",
    "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. 東京都は日本の首都です。 🙂🙂🙂",
    "a " * 30_000,
    "x" * 20_000,
    "<|endoftext|> inside a text, <|endoftext|>",
    "tabs\tand\r\nline ends\n\n\n   and runs    of blanks   ",
    "\x00\x01 control \x7f characters   and 　 wide spaces   ends",
]


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest table of documents, with its rows on the driver."""
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward texts with repeated rows, null ids and columns whose names clash with the operators' own."""
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(3, "word"), (None, "word"), (None, None)]
    clashing = "n long, key string, hash long, start int, label string, segment long, bucket long, sum long, doc long, rep long, gone string, n_words long, n_removed long, score double, host string"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {clashing}"
    tail = (1, "k", 2, 3, "l", 4, 5, 6, 7, 8, "g", 9, 10, 0.5, "h")
    return spark.createDataFrame([(d, t, "en" if d else None, None, None if t is None else len(t), *tail) for d, t in rows], schema)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")


def pairs(df):
    """(doc_id, text) of every row."""
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}
