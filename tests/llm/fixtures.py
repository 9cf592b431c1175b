"""Small awkward tables for the operators' tests."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int"


def awkward_documents(spark, long_words=30_000):
    """Nulls in every column, empty, blank and very long texts, repeated rows, a
    repeated id, special spellings, foreign scripts, clashing column names."""
    rng = random.Random(5)
    words = ["the", "of", "tion", "idiot", "éa", "Über", "a", "1.5", "don't", "x" * 40, "<|endoftext|>", "日本語", " ", "é", "#", "|"]
    texts = [None, "", "   \n\t ", "a", "A\nA\n\nA", "one two three", "one two three", "12 34 !!", "İstanbul 한   x"]
    texts += [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 60, 200, 900)]
    texts.append(" ".join(rng.choice(words[:6]) for _ in range(long_words)))
    texts.append("z" * 20_000)
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "k", 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (3, "other text of the same id", "de", "s", 1, None, None), (None, "no id here", None, None, None, None, None), (None, None, None, None, None, None, None), (-4, "negative id", "fr", "s", 1, "k", 2)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
