import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, id string, k1 string, fp string, term string, score string, lines string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(n, seed):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(9)) * r.randrange(2) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and long texts, ties, repeated rows, clashing columns."""
    texts = [
        None,
        "",
        " ",
        "\n\n \t",
        "a",
        "Ünï cödé 你好 😀 İ",
        "one two three four five six seven eight nine ten",
        prose(60, 1),
        prose(60, 1),
        prose(20_000, 2),
        "x" * 40_000,
        "line one is here\nline one is here\nother line stands here",
    ]
    rows = [(k, t, "en", "s", None, 1, "c", "c", "c", "c", "c", "c") for k, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, prose(60, 3), None, None, 5, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
