"""Small documents with the awkward cases every operator must take."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, target string"
LONG = " ".join(f"word{i % 997}" for i in range(6000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a"),
    (2, "", "en", "a"),
    (3, None, "en", "b"),
    (4, "   \t\n ", None, "b"),
    (5, LONG, "en", None),
    (5, LONG, "en", None),
    (6, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "a"),
    (7, "x" * 5000, "fr", "b"),
    (None, "no id here, mail me at a.b@c.de", "en", "a"),
    (9, "Licensed under the Apache License, Version 2.0. Done.", "en", "c"),
    (10, "Licensed under the Apache License, Version 2.0. Done.", "en", "c"),
    (-3, "the quick BROWN fox jumps over the lazy dog and runs away from it.", "en", "a"),
]


def documents(spark, rows=ROWS):
    full = [(i, t, lang, source, len(t) if t else None, 77, "clash", "clash") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCUMENTS)
