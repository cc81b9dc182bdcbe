import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ka lo mi nu re sa ti vo".split() for b in "ban der fil gos hum jex".split()] + "the of and to in is that".split()


def prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    out = [rng.choice(words) for _ in range(n)]
    return "".join(w + (". " if rng.random() < 0.08 else "\n" if rng.random() < 0.03 else " ") for w in out).strip()


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): prose, copies, near copies, a shared passage, nulls, empties, a long text, repeated rows."""
    texts = [prose(i, 120) for i in range(30)]
    passage = prose("passage", 90)
    texts += [texts[0], texts[0], edited(texts[1], 1, 0.02), edited(texts[1], 2, 0.02), edited(texts[2], 3, 0.2)]
    texts += [prose(100 + i, 60) + " " + passage + " " + prose(200 + i, 60) for i in range(4)]
    texts += [None, "", "   \n\t ", "one", "one two three", "One Two Three İß é \U0001f600", prose("long", 40_000), "word " * 3000, "#!! %% $$", "a.b,c;d"]
    base = prose("group", 150)
    texts += [edited(base, 1000 + i, 0.03) for i in range(40)]
    return list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (4, "another text with the same id " + prose(77, 30))]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows] + [(None, "a text without an id", None, None, None)], COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns whose names the operators use."""
    from pyspark.sql import functions as F

    names = "key class words score n n_words n_shingles text_hash item_id label spans _id _key _n at hash bucket token row html url".split()
    return docs.select("*", *(F.lit(1).alias(n) for n in names))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
