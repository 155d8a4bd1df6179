import pytest

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho "
         "sigma tau upsilon phi chi psi omega").split()


def sentence(seed: int, n: int) -> str:
    """n words, the same for the same seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 4) % 97))
    return " ".join(out)


def odd_documents() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows; columns beyond id and text clash with results."""
    long = sentence(3, 6000)
    rows = [
        (0, sentence(1, 60), "en"), (1, None, "en"), (2, "", None), (3, " \n\t ", "de"),
        (4, long, "en"), (5, sentence(1, 60), "en"), (6, sentence(1, 55) + " Ünïcode ÀB.c", "fr"),
        (7, sentence(8, 40) + "\n" + sentence(8, 40) + "\n" + sentence(9, 3), "en"),
        (8, "one", "en"), (9, "no gap\nno gap\n  no gap\n\n\n", "en"),
        (10, sentence(10, 12) + " " + sentence(1, 60)[:300], "en"),
        (11, "THE!! OF!! AND!! " * 6, "en"), (12, "a| b| c# d$ e% f& g* h< i> j|" * 3, "en"),
        (13, "你好 世界 " * 8, "zh"), (14, "x" * 5000, "en"),
        (15, sentence(15, 9), "en"), (16, "é \U0001f600    z", "en"),
        (17, sentence(17, 80), "en"), (17, sentence(17, 80), "en"), (None, sentence(18, 30), "en"),
    ]
    return [(i, t, lang, len(t or ""), True, 5) for i, t, lang in rows]


COLUMNS = ("doc_id long, text string, lang string, n_words int, kept boolean, n_hit int")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
