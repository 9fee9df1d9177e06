"""Awkward tables every operator must take."""

import random

KIND = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept boolean, row string, size string, rid long, item long, component string, _text string, words string"
)
CLASH = (True, "r", "s", -1, -2, "c", "t", "w")


def sentence(rng, n=60, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n)) + "."


def rows():
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.replace("w1 ", "changed ", 1)
    long_text = "\n".join(sentence(rng, 80, 5000) for _ in range(250))
    plain = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b ", "en", "", 4),
        (4, "one", "en", "a", 3),
        (5, base, "en", "a", len(base)),
        (6, base, "en", "b", len(base)),
        (6, base, "en", "b", len(base)),  # repeated whole
        (7, near, None, None, len(near)),
        (7, sentence(rng), "en", "a", 1),  # repeated id
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
        (8, long_text, "en", "b", len(long_text)),
        (9, "É ü ß 中文 \U0001f600 12 ½", "xx", "é", 1),
        (10, base.upper(), "en", "a", 1),
        (-11, sentence(rng, 30) + "\n" + base + "\n" + sentence(rng, 30), "en", "a", 1),
    ]
    return [r + CLASH for r in plain]


def table(spark, which=None):
    return spark.createDataFrame(rows() if which is None else which, KIND)
