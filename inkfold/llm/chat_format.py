"""Chat formatting whose output provably parses back, with DataFrame functions only.

Grammar (level is one digit)::

    conversation = "<s" level ">" turn*
    turn         = "[INST]" role "[/INST]" text "</s>"

The parser is deterministic: it cuts the body at each "</s>", and each turn at its first "[/INST]"; a role or text with a
control string left in it is no turn. A conversation is rendered as it is (level 0), parsed and compared with its source.
Where the turns differ, because texts or roles hold control strings, it is rendered again with those escaped (level 1), parsed and compared. Level 1 puts
one backslash after the first character of each control string, and of each that has backslashes
there already; taking one away restores the text, and no escaped text holds a control string. A
conversation that still differs makes the query fail rather than be stored wrongly.

A conversation is one row of the output, so its turns meet in one task, as they must; work grows with its length, but
for the list of spans, which is copied for each of them.

Nulls: a null role or text is empty. Turns are ordered by turn, then role, then text, which settles ties; null turns come
first. Repeated rows are turns of their own. Rows with a null id are one conversation. Texts of any length and any number
of turns are formatted whole. Other columns aren't read, so their names don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, OPEN, CLOSE = "</s>", "[INST]", "[/INST]"
_BROKEN = r"(\\*)(/s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])" + _BROKEN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\" + _BROKEN, "$1$2$3")


def render(turns: Column, level: int) -> Column:
    """turns is an array of (role, text) without nulls."""
    e = escape if level else (lambda x: x)
    one = F.transform(turns, lambda t: F.concat(F.lit(OPEN), e(t["role"]), F.lit(CLOSE), e(t["text"]), F.lit(END)))
    return F.concat(F.lit(f"<s{level}>"), F.array_join(one, ""))


def _level(formatted: Column) -> Column:
    return F.substring(formatted, 3, 1)


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text), null for what is no turn."""
    pieces = F.split(F.substring(formatted, 5, 2**31 - 1), END)
    escaped = _level(formatted) == "1"

    def turn(piece: Column) -> Column:
        at = F.instr(piece, CLOSE)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(piece, at + len(CLOSE), F.length(piece))
        clean = ~(F.contains(role, F.lit(OPEN)) | F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)))
        return F.when(clean, F.struct(
            F.when(escaped, unescape(role)).otherwise(role).alias("role"),
            F.when(escaped, unescape(text)).otherwise(text).alias("text"),
        ))

    # Behind the last END there is an empty piece.
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """Where the loss mask is on: array of (start, length), in code points from 0, of the role's texts."""
    pieces = F.split(F.substring(formatted, 5, 2**31 - 1), END)
    head = OPEN + role + CLOSE
    kind = "struct<at:int,spans:array<struct<start:int,length:int>>>"

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + len(head)
        mine = F.array(F.struct(start.cast("int").alias("start"), (F.length(piece) - len(head)).cast("int").alias("length")))
        return F.struct(
            (acc["at"] + F.length(piece) + len(END)).cast("int").alias("at"),
            F.when(F.startswith(piece, F.lit(head)), F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"),
        ).cast(kind)

    begin = F.struct(F.lit(4).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")).cast(kind)
    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), begin, step, lambda acc: acc["spans"])


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, without anything between."""
    escaped = _level(formatted) == "1"

    def span(s: Column) -> Column:
        text = F.substring(formatted, s["start"] + 1, s["length"])
        return F.when(escaped, unescape(text)).otherwise(text)

    return F.array_join(F.transform(spans, span), "")


def format_chats(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, formatted string, loss_spans array<struct<start, length>>) for each conversation of df."""
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    turns = F.transform(
        F.sort_array(F.collect_list("row")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    source = df.select(F.col(id_col), row.alias("row")).groupBy(id_col).agg(turns.alias("turns"))
    tried = source.withColumn("plain", render(F.col("turns"), 0))
    tried = tried.withColumn("fits", parse(F.col("plain")) == F.col("turns"))
    tried = tried.withColumn("formatted", F.when(F.col("fits"), F.col("plain")).otherwise(render(F.col("turns"), 1)))
    checked = F.when(F.col("fits") | (parse(F.col("formatted")) == F.col("turns")), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("doesn't parse back: conversation "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    )
    return tried.select(id_col, checked.alias("formatted")).withColumn("loss_spans", loss_spans(F.col("formatted")))
