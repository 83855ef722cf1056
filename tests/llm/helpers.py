"""Small tables for the tests of the text operators."""

import random

LETTERS = str.maketrans("0123456789", "aeioubdgnt")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, ids=None, sources=None, **extra):
    ids = range(1, len(texts) + 1) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, len(t) if t else 0) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("w" + str(rng.randrange(vocabulary)).translate(LETTERS) for _ in range(n))


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
