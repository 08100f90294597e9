import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `size` string, `batch` string"


def sentence(rng, words):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with nulls everywhere, empty, long, repeated and nearly repeated texts, and columns
    whose names the operators use inside."""
    rng = random.Random(3)
    shared = sentence(rng, 40)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[k] for k in range(0, 20, 2)]
    for k in range(20, 40, 2):
        words = texts[k].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words) + "\n" + shared)
    texts += [None, "", " \n ", "aa" * 40, "x" * 20000, sentence(rng, 9000), "A b c <|endoftext|> ##", "\n\n\nq  r\t\n"]
    rows = [
        (i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", None]), len(t or ""), "clash", "clash")
        for i, t in enumerate(texts)
    ]
    rows += [(None, "no id at all but words", "en", "s1", 22, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.limit(0)
