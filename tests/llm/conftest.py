import random

import pytest

WORDS = [a + b for a in ("ba", "to", "li", "re", "nu", "sha", "é") for b in ("n", "rk", "st", "mo", "lla", "ti", "x")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        word = rng.choice(WORDS) + rng.choice(WORDS)
        out.append(word.capitalize() if i % 9 == 0 else word)
        if i % 9 == 8:
            out[-1] += rng.choice([".", ".\n", ".  "])
    return " ".join(out)


def edited(text: str, seed: int, every: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    return " ".join(rng.choice(WORDS) if i % every == every - 1 else w for i, w in enumerate(words))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: nulls, empty and short ones, copies, near copies, shared passages, a repeated row, a long one."""
    passage = prose(1, 120)
    rows = [(i, prose(100 + i, 60 + 7 * i)) for i in range(30)]
    rows += [(40 + i, edited(prose(2, 300), i, 60 + i)) for i in range(8)]
    rows += [(60 + i, prose(200 + i, 30) + "\n" + passage + " " + prose(300 + i, 25)) for i in range(6)]
    rows += [(80, prose(3, 90)), (81, prose(3, 90)), (82, prose(3, 90)), (82, prose(3, 90))]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "x"), (94, "One two three."), (95, "one TWO three."), (96, "é " * 30)]
    rows += [(97, prose(4, 6000)), (98, "tick tock " * 200), (99, "tick tock " * 150), (70, prose(4, 6000)[5000:9000])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with further columns, some named like results."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t or ""), i, "own") for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, tag string"
    return spark.createDataFrame(rows, schema).repartition(5, "n_chars")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
