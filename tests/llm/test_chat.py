"""Chat formatting of very long and hostile roles and texts."""

from corpusloom.llm import chat


def test_roles_and_texts_of_a_megabyte(spark):
    million = 1 << 20
    plain, escapes = "a" * million, "\\\\:/#" * (million // 4)
    colons, marks = ": " * (million // 2), "### </turn>\n" * (million // 12)
    pairs = [(plain, "x"), (escapes, "x"), (colons, "x"), (marks, "x"), ("user", plain), ("user", escapes), ("user", colons), ("user", marks), ("a:b", "c"), ("a\\", "b"), (":", ":"), ("", ": ")]
    rows = [(k, t, *pair) for k, pair in enumerate(pairs) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: [(t["role"], t["text"]) for t in r["parsed"]] for r in chat.format_chat(df).select("conv_id", "parsed").collect()}
    assert out == {k: [pair] * 2 for k, pair in enumerate(pairs)}
