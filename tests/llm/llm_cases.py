"""Documents that operators must bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named as the operators name their own.
EXTRA = ("row", "id", "n", "digest", "signature", "key", "label", "kept", "limit", "perplexity", "words", "html", "media", "item_id", "fold", "e", "m")


def awkward():
    """Null and empty texts, one word, white space only, a null id, repeated rows, ties and very long texts."""
    long = "the quick brown fox jumps over the lazy dog and runs away from it " * 4000
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "word", "en"), (4, " \t\n ", "en"), (None, "a text without any id at all", "en"), (5, "The same text twice, as two rows.", "en"),
        (5, "The same text twice, as two rows.", "en"), (6, "the SAME text twice, as two rows.", "fr"), (7, long, "en"), (8, "x" * 200_000, None), (9, "ünïcode — 漢字 🎉 и кириллица", "ru"),
        (10, "tie one two three four", "en"), (11, "tie one two three four", "en"), (-12, "negative ids are ids as well", "en"),
    ]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
