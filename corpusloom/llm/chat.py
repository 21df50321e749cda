"""Chat formatting by grammar round trip, in DataFrame functions only.

A turn is rendered as ``### <role>: <text></turn>\\n``. The parser is deterministic: it cuts
the text after every ``</turn>\\n``, takes the role up to the first ``: `` and undoes escapes;
a control string that isn't escaped is a grammar error. Every turn is rendered plainly first,
parsed again and compared with its source. While they differ, the next rule of LEVELS
escapes more of it. The whole conversation is parsed and compared once more in the end.

Defined results: a null role or text counts as empty, a null turn number sorts first, equal
turn numbers are ordered by role and text (repeated rows stay), rows with a null conv_id
form one conversation, an empty table gives no rows. Extra columns are ignored. A
conversation is one output text and so one row, however many turns it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import let

HEAD, SEP, END = "### ", ": ", "</turn>\n"
#: What is escaped, by a backslash before it: nothing; what the parser would misread; every character of a control string.
LEVELS = (None, r"(\\|(?<=<)/(?=turn>)|(?<=##)#)", r"([\\/#:])")
ROLE_LEVELS = (None, r"(\\|(?<=<)/(?=turn>)|(?<=##)#|:)", r"([\\/#:])")
_ESCAPED = r"\\([\\/#:])"


def _escape(text: Column, rule: str | None) -> Column:
    return text if rule is None else F.regexp_replace(text, rule, r"\\$1")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(HEAD), _escape(role, ROLE_LEVELS[level]), F.lit(SEP), _escape(text, LEVELS[level]), F.lit(END))


def _parse_chunk(chunk: Column) -> Column:
    """struct(role, text, raw, ok) of what stood before one ``</turn>\\n``.

    The role ends at the first colon that isn't escaped. It is found by place in a copy whose escapes are blanked out
    to the same length, so no pattern repeats a group, which Java's matcher would do by recursion.
    """
    blanked = F.regexp_replace(chunk, r"(?s)\\.", "__")

    def cut(s: Column) -> Column:
        head, at = len(HEAD), F.instr(s["blanked"], ":")
        role, raw = F.substring(s["chunk"], F.lit(head + 1), at - (head + 1)), F.substring(s["chunk"], at + len(SEP), F.length(s["chunk"]))
        bare = F.regexp_replace(F.substring(s["chunk"], F.lit(head + 1), F.length(s["chunk"])), _ESCAPED, "")
        ok = s["chunk"].startswith(HEAD) & (at > head) & (F.substring(s["blanked"], at, F.lit(len(SEP))) == SEP) & ~bare.contains("###") & ~bare.contains("</turn>")
        return F.struct(_unescape(role).alias("role"), _unescape(raw).alias("text"), raw.alias("raw"), ok.alias("ok"))

    return let(F.struct(chunk.alias("chunk"), blanked.alias("blanked")), cut)


def _chunks(formatted: Column) -> Column:
    parts = F.split(formatted, END)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text, raw, ok>> of a formatted conversation."""
    return F.transform(_chunks(formatted), _parse_chunk)


def _round_trips(role: Column, text: Column, rendered: Column) -> Column:
    chunks = _chunks(rendered)
    one = _parse_chunk(F.get(chunks, F.lit(0)))
    return (F.size(chunks) == 1) & one["ok"] & (one["role"] == role) & (one["text"] == text)


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (start and length in code points of every loss text), parsed."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    shown = size = None
    for level in range(len(LEVELS)):
        out = _render(F.col("role"), F.col("text"), level)
        ok = _round_trips(F.col("role"), F.col("text"), out)
        length = F.length(_escape(F.col("text"), LEVELS[level]))
        shown = F.when(ok, out) if shown is None else shown.when(ok, out)
        size = F.when(ok, length) if size is None else size.when(ok, length)
    rows = rows.withColumns({"shown": shown.otherwise(F.raise_error(F.lit("a turn can't be escaped"))), "size": size})
    # Where a turn's text begins: what stands before the turn, and its own head. Sum and group share one shuffle.
    before = F.sum(F.length("shown")).over(W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("start", (F.coalesce(before, F.lit(0)) + F.length("shown") - F.col("size") - len(END)).cast("int"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "start", "size", "shown"))).alias("turns"))
    out = grouped.select("conv_id", "turns", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"))
    out = out.withColumn("parsed", parse_chat(F.col("formatted")))
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"], t["text"]))
    same = (plain("turns") == plain("parsed")) & F.forall("parsed", lambda t: t["ok"])
    spans = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), t["size"].alias("length")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't round-trip"))).alias("formatted"),
        spans.alias("loss_spans"),
        "parsed",
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """Text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: _unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digest(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted texts."""
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
