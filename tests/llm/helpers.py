"""Small tables with the awkward rows every corpus operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string"


def frame(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source) with columns whose names operators use themselves."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, 0.5, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def awkward(seed=1):
    """Null and empty texts, ties, repeated rows, a null id, a very long text, odd white space and bytes."""
    rng = random.Random(seed)
    words = ["the", "of", "Der", "und", "la", "naïve", "x,", "zß", "😀", "a.b", "##", "idiot"]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r "), (203, "word"), (204, "A b\nA b\n\nA b"), (205, "\x00 \\ </s>")]
    rows += [rows[3], rows[3], (206, rows[3][1]), (None, rows[5][1]), (207, "é" * 5000), (208, "the cat sat on the mat " * 2000)]
    return rows
