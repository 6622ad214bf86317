r"""Chat formatting with a grammar round trip.

Template. A conversation is the concatenation of its turns; a turn is ``<s>[INST] role [/INST]text</s>``.

Grammar of the parser (deterministic): split at ``</s>``; each piece begins with ``<s>[INST] ``; the role runs to the first
`` [/INST]`` and the text is the rest. Texts and roles are then unescaped.

Escape. A backslash becomes ``\e``, and each control string gets ``\p`` after its first character (``<\p/s>``), so an escaped
text holds no control string, whatever it is made of. Unescaping removes every ``\p`` and turns ``\e`` back.

Round trip. The first rendering writes texts as they are. It is parsed and compared with the source turn by turn; a conversation that does not
come back identical is rendered with its conflicting turns escaped, and if that should fail, with all turns escaped. ``level`` tells which
rendering was kept (0, 1, 2) and ``identical`` that it came back.

Only DataFrame functions; one shuffle by conversation. A conversation's text is one value, so its turns meet in one row.

Defined cases: a null role or text is empty; a null conversation id is a conversation; turns with equal numbers are ordered by role and text, and
repeated rows are kept; null turn numbers come first; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
OPEN, MID, CLOSE = "<s>[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\p" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("")), F.lit("\\e"), F.lit("\\"))


def conflicts(text: Column) -> Column:
    """The text would not come back if it were written as it is."""
    hit = text.contains("\\p") | text.contains("\\e")
    for c in CONTROL:
        hit = hit | text.contains(c)
    # the start of a control string at the end of a text could be completed by the template
    return hit | text.rlike(r"(<|</|</s|\[|\[/|\[I\w*|\[/I\w*)$")


def render(turns: Column, write) -> Column:
    """One string; ``write(text)`` gives a turn's written text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), write(t["role"]), F.lit(MID), write(t["text"]), F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>``; null when the string is not of the grammar."""
    pieces = F.split(formatted, CLOSE, -1)
    body = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    ok = (F.element_at(pieces, -1) == "") & F.forall(body, lambda p: F.startswith(p, F.lit(OPEN)) & p.contains(MID))

    def turn(p: Column) -> Column:
        rest = F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
        role = F.substring_index(rest, MID, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(rest, F.length(role) + len(MID) + 1, F.length(rest))).alias("text"))

    return F.when(ok, F.transform(body, turn))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``<id>, formatted, level, identical, turns`` (turns as read back from ``formatted``) per conversation."""
    r = rows.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                                                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    c = r.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    c = c.select("id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    writers = [lambda x: x, lambda x: F.when(conflicts(x), escape(x)).otherwise(x), escape]
    c = c.withColumn("formatted", render(F.col("source"), writers[0])).withColumn("level", F.lit(0))
    c = c.withColumn("turns", parse(F.col("formatted")))
    for level in (1, 2):  # escape further only what did not come back identical
        again = ~F.col("turns").eqNullSafe(F.col("source"))
        c = c.withColumn("formatted", F.when(again, render(F.col("source"), writers[level])).otherwise(F.col("formatted")))
        c = c.withColumn("level", F.when(again, F.lit(level)).otherwise(F.col("level")))
        c = c.withColumn("turns", F.when(again, parse(F.col("formatted"))).otherwise(F.col("turns")))
    return c.select(F.col("id").alias(id_col), "formatted", "level", F.col("turns").eqNullSafe(F.col("source")).alias("identical"), "turns")


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: the texts of one role, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")
