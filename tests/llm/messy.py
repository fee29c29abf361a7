"""Small documents with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, line string, H string, words string"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows():
    base = prose(1, 120)
    texts = [
        (0, base), (1, base), (2, base + " tail"), (3, None), (4, ""), (5, " \t\n\r\x0b\x0c "), (6, "one"), (7, "one two"),
        (8, "A shared line of text\nOwn line number eight\n\nA shared line of text"), (9, "  a SHARED line of text\t\nshort\nshort\nlast"),
        (9, "  a SHARED line of text\t\nshort\nshort\nlast"), (10, prose(2, 5000)), (None, "A shared line of text\nnull id"), (None, "null id line twice"),
        (None, "null id line twice"), (11, "Ünï cödé words   are　kept\x85here"), (12, "x" * 3000), (13, "same same same same " * 30),
        (14, base.replace("w1 ", "w2 ", 1)), (15, "\n".join(["dup line here ok"] * 4)), (16, "&amp; <| <b> # * $ % & | >")]
    return [(i, t, [None, "en", "fr", ""][k % 4], [None, "a", "b", "a"][k % 4], 1, 0.5, "x", "y", "z") for k, (i, t) in enumerate(texts)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
