import random

import pytest

WORDS = "the of and river stone lamp tree wind salt road open quiet north seven glass iron".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "er"]) for _ in range(n)]
    return " ".join(w + (rng.choice([".\n", " "]) if i % 9 == 8 else "") for i, w in enumerate(words))


ODD_TEXTS = [None, "", "   \n\t ", "one", "two words", "\n\n\n", "é ñ ß", "A\x0bB\x0cC", "x" * 5000]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose with exact copies, near copies, shared passages, and odd texts."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([8, 40, 90, 200])) for _ in range(40)]
    passage = prose(rng, 60)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 15) for _ in range(6)]
    texts += [texts[3]] * 5 + [texts[7].replace("river", "lake", 1), texts[8] + " more"]
    texts += [prose(rng, 30) + " " + prose(rng, 3) * 40]
    texts += ODD_TEXTS
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table whose further columns have names that operators use inside, with a repeated row."""
    rows = [(d, t, "en", f"src{d % 3}", len(t or ""), d, "x", 7) for d, t in corpus]
    return spark.createDataFrame(rows + [rows[0]], "doc_id long, text string, lang string, source string, n_chars long, "
                                 "key long, found string, n long").repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
