"""Chat formatting: a finite-state machine over roles and a declarative template. DataFrame functions only.

A conversation becomes a list of segments ``(text, loss)`` whose concatenation is the formatted text: each turn gives
the opening mark of its role, the escaped text (under the loss where the template says so) and the closing mark. Inside
texts a backslash is doubled and every control string gets a backslash after its first character, so no control string
is left in a text and :func:`unescape` restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> opening mark, closing mark, whether its text is under the loss.
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Any other role, url-encoded, stands in the opening mark; its text is never under the loss.
OTHER = ("<role=", ">", "</role>")
#: state -> role -> next state; what is absent is invalid. "reply" alone accepts.
MACHINE = {
    "start": {"system": "ready", "user": "asked"},
    "ready": {"user": "asked"},
    "asked": {"assistant": "reply"},
    "reply": {"user": "asked"},
}
ACCEPTS = ("reply",)

#: A position after the first character of a control string.
_CONTROL = r"(<(?=s>|/s>|<SYS>>|</SYS>>|role=|/role>)|\[(?=/?INST\]))"
_TURN = r"(?s)(<<SYS>>|\[INST\]|<s>|<role=[^>]*>)(.*?)(?:<</SYS>>|\[/INST\]|</s>|</role>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _state(roles: Column) -> Column:
    """The machine's state after all roles; null once a turn is invalid."""
    step = lambda state, role: F.coalesce(
        *[F.when((state == s) & (role == r), F.lit(to)) for s, next_ in MACHINE.items() for r, to in next_.items()]
    )
    return F.aggregate(roles, F.lit("start"), step)


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, segments array<struct<text, loss>>, formatted, valid)``, one row per conversation.

    Null roles and texts count as empty; turns go by number (null first), then role, then text. Repeated rows are turns
    of their own. ``valid`` tells whether the machine accepts the roles; invalid conversations are formatted alike. A
    null conv_id is a conversation. Other columns are not read. One conversation is one row, as its digest demands.
    """
    row = F.struct(F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    d = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def pick(value, other) -> Column:
        return lambda r: F.coalesce(*[F.when(r == k, F.lit(value(v))) for k, v in TEMPLATE.items()], other(r))

    opened = pick(lambda v: v[0], lambda r: F.concat(F.lit(OTHER[0]), F.url_encode(r), F.lit(OTHER[1])))
    closed = pick(lambda v: v[1], lambda r: F.lit(OTHER[2]))
    under = pick(lambda v: v[2], lambda r: F.lit(False))
    segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    parts = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(opened(t["role"]), F.lit(False)), segment(escape(t["text"]), under(t["role"])), segment(closed(t["role"]), F.lit(False))
            ),
        )
    )
    d = d.select("conv_id", parts.alias("segments"), F.coalesce(_state(F.transform("turns", lambda t: t["role"])).isin(*ACCEPTS), F.lit(False)).alias("valid"))
    return d.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted text."""
    marks, texts = F.regexp_extract_all(formatted, F.lit(_TURN), 1), F.regexp_extract_all(formatted, F.lit(_TURN), 2)
    known = lambda m: [F.when(m == v[0], F.lit(k)) for k, v in TEMPLATE.items()]
    other = lambda m: F.url_decode(F.substring(m, F.lit(len(OTHER[0]) + 1), F.length(m) - len(OTHER[0]) - 1))
    return F.zip_with(
        marks, texts, lambda m, t: F.struct(F.coalesce(*known(m), F.when(m.startswith(OTHER[0]), other(m))).alias("role"), unescape(t).alias("text"))
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of :func:`format_chats`: turns, loss text and length."""
    d = formatted.select("*", read_turns(F.col("formatted")).alias("__kerb_turns"))
    said = F.array_join(F.transform("__kerb_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    d = d.withColumn("__kerb_loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""))
    return d.select(
        "conv_id",
        F.size("__kerb_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("__kerb_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__kerb_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
