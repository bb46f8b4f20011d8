import pytest

PROSE = ("the river ran past the old mill and the miller counted his sacks of grain while the boats went by under a low grey sky "
         "and nobody in the village could say when the rain would end or whether the road to the coast was open again this year")


@pytest.fixture(scope="session")
def prose():
    return PROSE


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, repeated rows, a long text, columns named like results."""
    long = " ".join(f"word{i} stands here" for i in range(12_000))
    rows = [(1, PROSE, "x", 9), (2, PROSE, "y", 9), (3, None, "z", None), (4, "", None, 0), (5, "   \n\t ", "w", 1), (6, long, "v", 2),
            (None, "short text", "u", 3), (7, "ünï çödé 日本語 🙂", "t", 4), (2, PROSE, "y", 9), (8, PROSE.replace("river", "brook"), "s", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
