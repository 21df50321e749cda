import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, and extra columns named like an operator's own."""
    words = [f"w{k}" for k in range(400)]
    long_ = " ".join(f"x{k % 977}y{k % 1009}" for k in range(60_000))
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [
        (1, " ".join(words[:200]), "en", "a"),
        (2, " ".join(words[:200]), "en", "a"),
        (3, " ".join(words[:195] + ["zz"] + words[196:200]), None, "a"),
        (4, None, "en", None),
        (5, "", None, None),
        (6, " \n\t ", "en", "a"),
        (7, "one two", "en", "a"),
        (8, "ONE  two", "en", "a"),
        (9, long_, "en", "b"),
        (10, "é" * 80 + " ü " + passage, "fr", "b"),
        (11, "start of it. " + passage + " and its end 🙂", "de", "b"),
        (12, passage, "de", "b"),
        (12, passage, "de", "b"),
        (13, "\n".join(["a line that repeats itself here"] * 12), "en", "a"),
        (14, " ".join(["spam ham eggs bacon tea jam toast bread"] * 30), "en", "a"),
        (None, " ".join(words[200:300]), "en", "a"),
        (15, " ".join(words[200:300]), "en", "a"),
        (16, "A" * 300, "en", "a"),
        (17, "b" + "A" * 120 + "c", "en", "a"),
    ]
    extra = [(d, t, lang, s, None if t is None else len(t), 7, "k", 1.5, d, "c", b"x", "f") for d, t, lang, s in rows]
    return spark.createDataFrame(extra, DOCS + ", n_words long, kept string, found double, gone_id long, cls string, mins binary, k0 string")
