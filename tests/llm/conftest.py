import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, fp string, rank string, unit string, word string"


def prose(rng: random.Random, n: int) -> str:
    syllables = "the an er ing on re th ti he in ou nd ea ha es at or st nt".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." * (i % 9 == 8) for i, w in enumerate(words))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(7)
    texts = [prose(rng, rng.choice([3, 40, 120, 400])) for _ in range(50)]
    texts += [texts[3]] * 12 + [texts[5] + " more", texts[5] + " less", None, "", " \n\t", "x", "éü ß 日本 😀", "a" * 3000, prose(rng, 9000)]
    out = [(i, t, ("en", "de", None)[i % 3], "s", len(t or ""), "x", "y", "z", "u", "w") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "null id", "en", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
