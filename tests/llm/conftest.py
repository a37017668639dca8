import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, copies string, kept string, ids string, fp string, v string"

PROSE = (
    "the old harbour lies quiet under a pale morning sky and the boats rest on the sand while nobody hurries along the pier "
    "because the tide will not turn before noon and the men know it well enough to sleep a little longer than usual today"
).split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    while len(out) < words:
        sentence = rng.choices(PROSE, k=rng.randint(6, 14)) + [f"word{rng.randint(0, 400)}x"]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + rng.choice([".", ".", ".\n"])]
    return " ".join(out).replace("\n ", "\n").strip()


def rows():
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns whose names operators use."""
    texts = [(i, prose(i, 40 + 17 * (i % 9)), "en", f"src{i % 4}") for i in range(60)]
    texts += [
        (100, None, None, None), (None, prose(3, 80), "en", "src1"), (None, None, None, None), (101, "", "", ""),
        (102, " \n\t ", "en", "src0"), (103, prose(7, 60), "en", None), (103, prose(8, 70), "en", "src2"), (5, prose(5, 40 + 17 * 5), "en", "src1"),
        (104, prose(104, 30_000), "en", "src0"), (105, "x" * 50_000, "en", "src2"), (106, "a a a a a a a a " * 40, "en", "src3"),
        (107, "Äpfel und Öl für 中文 😀 naïve", "de", "src3"), (-4, prose(2, 74), "fr", "src0"),
    ]
    return [(d, t, lang, s, None if t is None else len(t), "a", "b", "c", "d", "e", "f") for d, t, lang, s in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    return rows()
