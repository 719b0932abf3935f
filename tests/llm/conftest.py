import pytest

#: A table with what operators must bear: nulls, empty and blank texts, repeated rows, ties, columns with clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, component string, size long, score double, words string, bands string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    texts = [None, "", " \n\t ", "word", prose(1, 80), prose(1, 80), prose(2, 9000), "é ß 日本語 😀 <|endoftext|> it's", 'token = "a1b2c3d4e5f6a7b8c9d0a1b2c3d4e5f6a7b8c9d0"', "x" * 5000, prose(3, 120), prose(3, 120) + " omega"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "a", "b", 1, 0.5, "w", "z") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, prose(9, 60), None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
