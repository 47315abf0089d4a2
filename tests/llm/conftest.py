import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, bucket string, ids string, n long"


def tricky_texts():
    """Copies, near copies, shared passages, odd characters, long, empty and null texts."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 7))) for _ in range(400)]

    def words(n):
        return [r.choice(vocabulary) for _ in range(n)]

    base = words(120)
    out = [" ".join(words(r.randint(8, 150))) for _ in range(40)]
    for k in range(16):  # a chain: ever more words replaced
        edited = list(base)
        for i in r.sample(range(120), k):
            edited[i] = r.choice(vocabulary)
        out.append(" ".join(edited))
    passage = " ".join(words(60))
    out += [f"{' '.join(words(20))} {passage} {' '.join(words(20))}" for _ in range(6)]
    out += [out[3], out[3], out[50], None, "", " \n\t ", "one", "One", "two words", "a b c d e", "A B C D E", "<|endoftext|> it's  here\u00a0now\u2003there \r\n end", "日本語 テスト", "e\u0301 \u0301x", "x" * 5_000]
    out += [" ".join(words(4_000)), "ab" * 400, "naïve  double   spaces\n\n\nlines", "I'M YOU'LL 123 4567 don't!!! ΑΣ Σ"]
    return out


@pytest.fixture(scope="session")
def texts():
    return tricky_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(3 * i - 20, t, "en", "s", None, i, "b", "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
