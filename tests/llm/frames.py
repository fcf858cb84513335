"""Awkward tables for the tests of the operators."""

import random


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOWELS, CONSONANTS = "aeiou", "bcdfghklmnprstvw"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice(CONSONANTS) + r.choice(VOWELS) for _ in range(r.randrange(1, 5))) for _ in range(words)]
    return " ".join(w + ("." if r.random() < 0.1 else "") for w in made)


def documents(spark, texts, ids=None, **columns):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCUMENTS)


def awkward_texts() -> list:
    """Nulls, empty and blank texts, ties, near copies, shared passages, one very long text, odd characters."""
    base = [prose(k, 40 + 7 * k) for k in range(12)]
    passage = prose(99, 60)
    near = base[3].split(" ")
    near[10] = "changed"
    return [
        None, "", "   \n\t ", base[0], base[0], base[1], base[1].upper(), base[2], *base[3:8], " ".join(near), base[4] + " tail.",
        passage + " " + base[8], base[9] + " " + passage, passage, passage * 3, prose(5, 30_000), "é ß 日本語 👍 \x00 İstanbul ΣΑΣ", None, "", "one", "one two three",
        "x" * 5000, "ab" * 400, base[0],
    ]


def with_clashes(frame, *names):
    """The same rows with more columns, of names that operators use themselves."""
    from pyspark.sql import functions as F

    for n in names:
        frame = frame.withColumn(n, F.lit("mine"))
    return frame
