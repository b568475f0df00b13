"""Small documents with what operators have to handle."""

import itertools

TRICKY = [
    None,
    "",
    " \n\t ",
    "one",
    "The same text twice over and over again for all to see, with words enough in it.",
    "The same text twice over and over again for all to see, with words enough in it.",
    "Ünïcödé wörds 日本語 ﬁ and no-break\r\nlines\x0b\x0c",
    "x" * 40_000 + " end",
    "a b c d e " * 2_000,
    "\n\n\n",
]


def documents(spark, texts=TRICKY, extra: bool = True):
    """doc_id, text and columns whose names clash with inner ones; one row is repeated, one has no id."""
    rows = [(i, t, "en" if i % 2 else None, "s", "keep", 7) for i, t in enumerate(texts)]
    rows += [(0, texts[0], None, "s", "keep", 7), (None, "no id here at all", "de", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, _text string, n_tokens int"
    frame = spark.createDataFrame(rows, schema)
    return frame if extra else frame.select("doc_id", "text", "lang", "source")


def empty(spark):
    return documents(spark).limit(0)


def shuffled_words(seed: int, n: int, vocabulary: int = 300) -> list[str]:
    import random

    r = random.Random(seed)
    words = ["".join(p) for p in itertools.islice(itertools.product("abcdefgh", repeat=4), vocabulary)]
    return [r.choice(words) for _ in range(n)]
