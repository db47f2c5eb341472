import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


@pytest.fixture(scope="session")
def corpus(words):
    """Rows of documents: plain, exact and near copies, a chain of near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []

    def add(t, lang="en", source="s1"):
        rows.append((len(rows), t, lang, source, len(t or "")))

    for k in range(40):
        add(text(rng.randint(60, 300)), rng.choice(["en", "de", None]), f"s{k % 4}")
    base = text(200).split()
    for _ in range(30):  # near copies of one text
        w = list(base)
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = rng.choice(words)
        add(" ".join(w), "en", f"s{rng.randrange(12)}")
    chain = text(120).split()
    for _ in range(12):  # each near to the one before, the ends far apart
        chain = chain[6:] + text(6).split()
        add(" ".join(chain))
    copy = text(80)
    for k in range(15):
        add(copy, "en", f"s{k}")
    passage = text(30)
    for _ in range(10):
        add(text(40) + "\n" + passage + "\n" + text(40), "de", f"s{rng.randrange(12)}")
    for t in ("", None, " \n\t ", "one", "one two three four", "ONE two three four", "é ü 日本語 🎉 ### $$$ !!! | | |", text(30000), "a b c " * 200, "x" * 5000):
        add(t, None, None)
    add(None, "fr", None)
    rows.append(rows[3])  # a repeated row
    rows.append((None, "no id but words enough to say so here", "en", "s1", 5))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus, with extra columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("size", "h", "id", "key", "n", "src", "shard", "part", "th", "length", "hot", "comp", "draws", "media")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
