import random

import pytest

WORDS = "alpha beta gamma delta omega north south river stone cloud paper glass light sound green amber quick slow".split()
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, _row string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Edge cases by id: null, empty, blank, short, repeated, long and many-byte texts."""
    shared = prose(1, 90)
    return {
        0: None,
        1: "",
        2: " \t\n\r\x0b\x0c ",
        3: "one",
        4: "Größe naïve — Σigma tail  two  spaces \n \n end ",
        5: prose(2, 40) + " " + shared + " " + prose(3, 40),
        6: prose(4, 60) + " " + shared,
        7: shared + " " + prose(5, 20),
        8: prose(6, 120),
        9: prose(6, 120),
        10: prose(6, 119) + " changed",
        11: "spam eggs " * 300,
        12: prose(7, 30) + "\n" + prose(7, 30) + "\n" + prose(8, 10),
        13: prose(9, 20000),
        14: shared[:-3] + " " + prose(10, 50) + " " + shared,
        15: "# $ % & | < > * " * 10,
    }


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "hot", "hot"][i % 5], len(t or ""), 1.5, "x", "r") for i, t in texts.items()]
    # A repeated row, a repeated id with another text, and a row without an id.
    rows += [rows[6], (8, prose(11, 70), "en", "a", 1, None, None, None), (None, prose(12, 45), None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
