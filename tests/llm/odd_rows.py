"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, points long, owner string, size int, digest string"
LONG = "the quick brown fox jumps over a lazy dog and runs away " * 4000
WORDS = "one two three four five six seven eight nine ten eleven twelve"

ROWS = [
    (1, WORDS, "en", "a", 1, None, "x", 1, "d"),
    (2, WORDS.upper(), "en", "a", None, 2, None, 2, None),
    (3, WORDS.replace(" ", "\t\n "), "en", "b", 3, None, "x", None, "d"),
    (4, WORDS + " thirteen", "en", None, 4, None, "x", 1, "d"),
    (5, None, "en", "a", 5, None, "x", 1, "d"),
    (6, "", None, "b", 6, None, "x", 1, "d"),
    (7, " \n", "fr", "c", 7, None, "x", 1, "d"),
    (8, LONG, "en", "c", 8, None, "x", 1, "d"),
    (9, LONG + "!", "en", "a", 9, None, "x", 1, "d"),
    (10, "bonjour à tous, la réunion est reportée à demain matin", "fr", "a", 10, None, "x", 1, "d"),
    (10, "bonjour à tous, la réunion est reportée à demain matin", "fr", "a", 10, None, "x", 1, "d"),
    (None, "a row without an id and some words", "en", "b", 11, None, "x", 1, "d"),
    (12, "1234 5678 !!", "de", "b", 12, None, "x", 1, "d"),
    (13, "bonjour à tous,la réunion est reportée à demain matin", "fr", "b", 13, None, "x", 1, "d"),
    (14, "one two", "en", "b", 14, None, "x", 1, "d"),
    (15, "One two", "en", "b", 14, None, "x", 1, "d"),
]


def odd_documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
