import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small texts: near copies, copies, null, empty, a repeated row, an id-less row, a column of a clashing name."""
    base = [f"word{i % 97} tale{i} of the river and hill number {i}" for i in range(40)]
    long = " ".join(base)
    rows = [
        (1, long, "en"), (2, long.replace("tale20", "story20"), "en"), (3, long, "en"), (4, None, None), (5, "", "en"),
        (6, "a few words", "fr"), (7, "a few words", "fr"), (8, "!!! ???", "de"), (9, "ü ö ä Straße É", "de"),
        (10, " ".join(reversed(long.split())), "en"), (10, " ".join(reversed(long.split())), "en"), (None, "no id here", None),
        (11, long + " " + " ".join(f"extra{i}" for i in range(400)), "en"), (12, "x " * 30_000, "es"),
    ]
    return spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, lang string, id int, digest string")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
