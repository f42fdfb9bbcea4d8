import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copy int, piece string, shard int, n_words string, component_id string, hash int, fingerprint string"
LONG = " ".join(f"word{i % 977}" for i in range(6000))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names operators use."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), None, 7, "p", None, None, "c", 1, "f") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty, very long and repeated texts, repeated rows, a null id and a null source."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, LONG), (7, LONG + " end"), (8, "Ünï ✓ 漢字 " * 30),
        (9, "the same text of some words " * 5, None), (10, "the same text of some words " * 5), (10, "the same text of some words " * 5), (None, "no id here"), (12, "x" * 3000),
    ]
    return make_docs(rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([(1, "x")]).where("false")
