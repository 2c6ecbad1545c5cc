"""Chat formatting with a grammar that is read back before anything is returned.

A conversation is the turns one after the other, each ``<turn>``, the role, a line break, the
text and ``</turn>`` with a line break. A turn that would not be read back as it is has the
mark ``<turn:esc>`` instead, and in its role and text a backslash stands doubled, each control
string is a backslash and a letter, and so is a line break inside a role. Only DataFrame
functions are used.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAIN, ESCAPED, END = "<turn>", "<turn:esc>", "</turn>"
# What stands for each control string after a backslash.
LETTERS = {PLAIN: "o", ESCAPED: "s", END: "c"}


def escape(text: Column, line_breaks: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, letter in LETTERS.items():
        out = F.replace(out, F.lit(control), F.lit("\\" + letter))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line_breaks else out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: between doubled backslashes every backslash opens a letter."""

    def piece(part: Column) -> Column:
        for control, letter in LETTERS.items():
            part = F.replace(part, F.lit("\\" + letter), F.lit(control))
        return F.replace(part, F.lit("\\n"), F.lit("\n"))

    return F.array_join(F.transform(F.split(text, "\\\\\\\\", -1), piece), "\\")


def render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        role, text = escape(role, line_breaks=True), escape(text)
    return F.concat(F.lit(ESCAPED if escaped else PLAIN), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, escaped>> of a formatted conversation; a deterministic parser.

    Turns end at ``</turn>`` with a line break. The mark in front tells whether the turn is
    escaped, and the first line break ends the role. A turn without a mark has a null role.
    """

    def turn(part: Column) -> Column:
        escaped = F.startswith(part, F.lit(ESCAPED))
        mark = F.when(escaped, F.lit(len(ESCAPED))).when(F.startswith(part, F.lit(PLAIN)), F.lit(len(PLAIN)))
        body = F.substring(part, mark + 1, F.length(part))
        line = F.instr(body, "\n")
        role = F.when(line > 0, F.substring(body, F.lit(1), line - 1))
        text = F.substring(body, line + 1, F.length(body))
        return F.struct(
            F.when(escaped, unescape(role)).otherwise(role).alias("role"),
            F.when(escaped, unescape(text)).otherwise(text).alias("text"),
            escaped.alias("escaped"),
        )

    parts = F.split(formatted, "\\Q" + END + "\n\\E", -1)
    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def format_conversations(
    rows: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row for each conversation: (id, formatted, loss).

    Each turn is rendered plainly and read back; if the result is not exactly its role and
    text, or holds a control string, it is rendered escaped. ``loss`` has (start, length,
    escaped) of the texts of ``trained_role`` in ``formatted``, in characters.

    Turns are in the order of ``turn``, nulls first, equal ones by role and text. Null roles
    and texts are empty; rows with a null id are one conversation; rows that repeat are turns
    of their own. Other columns are not read, and an empty table gives no conversation.
    """
    turns = rows.select(
        F.col(id_column).alias("id"),
        F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("plain", render(F.col("role"), F.col("text"), False))
    back = parse(F.col("plain"))
    same = (F.size(back) == 1) & back[0]["role"].eqNullSafe(F.col("role")) & back[0]["text"].eqNullSafe(F.col("text"))
    for control in LETTERS:
        same = same & ~F.contains("role", F.lit(control)) & ~F.contains("text", F.lit(control))
    turns = turns.withColumn("safe", same)
    turns = turns.withColumn("shown", F.when(F.col("safe"), F.col("plain")).otherwise(render(F.col("role"), F.col("text"), True)))
    body = F.when(F.col("safe"), F.length("text")).otherwise(F.length(escape(F.col("text"))))
    before = Window.partitionBy("id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.length("shown")).over(before)
    number = F.row_number().over(Window.partitionBy("id").orderBy("turn", "role", "text"))
    turns = turns.select(
        "id",
        number.alias("number"),
        "shown",
        (upto - F.lit(len(END) + 1) - body).alias("start"),
        body.alias("length"),
        (~F.col("safe")).alias("escaped"),
        (F.col("role") == trained_role).alias("trained"),
    )
    whole = turns.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("number", "shown", "start", "length", "escaped", "trained"))).alias("turns"))
    loss = F.transform(
        F.filter("turns", lambda t: t["trained"]),
        lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"), t["escaped"].alias("escaped")),
    )
    return whole.select(
        F.col("id").alias(id_column),
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        loss.alias("loss"),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""

    def span(s: Column) -> Column:
        own = F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
        return F.when(s["escaped"], unescape(own)).otherwise(own)

    return F.array_join(F.transform(loss, span), "")


def digests(formatted: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """What is read back from formatted conversations, as counts and digests."""
    turns = parse(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss"))
    return formatted.select(
        id_column,
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
