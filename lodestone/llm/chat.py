r"""Chat formatting by prefix-target expansion, on DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns up to it are formatted, and only its text
is trainable, given by a span of code points. The template is

    <|im_start|>ROLE\nTEXT<|im_end|>\n

A text that holds a control string is escaped by one backslash after the string's first character, and
one more where backslashes stand there already; taking one away again gives the text back, so no text
can pass for a mark. In a role, backslash and newline are escaped as well.

Turns after the last assistant turn, and conversations without one, are kept in an example without a
trainable span (target_turn null), so no turn is lost.

Edge cases: rows are ordered by turn (null first), then role, then text; a null text or role is empty;
turns may repeat; a null conv_id is a conversation of its own; an empty table gives no examples; extra
columns are not carried. The examples of a conversation hold each other's beginnings, so their size
grows with the square of its turns: that is the format itself. A conversation is put together in one
task, which needs a few times its text in memory (repeated rows are turns of their own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, each as its first character and the rest.
_CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"
_ESCAPED = _CONTROL.replace(r"(\\*)", r"\\(\\*)")
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), _escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def expand(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples: conv_id, example (from 0), target_turn (place of the trained turn, or null), formatted, loss_start, loss_end (code points)."""
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.select("conv_id", F.transform("ts", lambda t: _turn(t["role"], t["text"])).alias("formatted"), F.transform("ts", lambda t: t["role"] == TRAINED).alias("trained"))
    n = F.size("formatted")
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("trained", i) | (i == n))
    one = convs.select("conv_id", "formatted", "trained", F.posexplode(at).alias("example", "upto"))
    one = one.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.when(F.element_at("trained", F.col("upto")), F.col("upto") - 1).cast("long").alias("target_turn"),
        F.array_join(F.slice("formatted", 1, F.col("upto")), "").alias("formatted"),
        F.char_length(F.element_at("formatted", F.col("upto"))).alias("own"),
    )
    end = F.char_length("formatted") - len(END + "\n")
    head = F.lit(len(START + TRAINED + "\n"))
    trained = F.col("target_turn").isNotNull()
    return one.select("conv_id", "example", "target_turn", "formatted", F.when(trained, F.char_length("formatted") - F.col("own") + head).cast("long").alias("loss_start"), F.when(trained, end).cast("long").alias("loss_end"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text as array<struct<role, text>>, unescaped."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, F.lit(1 << 30))
    return F.transform(parts, lambda p: F.struct(_unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.locate("\n", p) + 1, F.char_length(p) - F.locate("\n", p) - len(END + "\n"))).alias("text")))


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text, unescaped."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns and what is trained."""
    last = F.max_by("formatted", "example")
    own = F.when(F.col("target_turn").isNotNull(), F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("x")))
    rows = examples.select("conv_id", "example", F.col("formatted"), own.alias("own"), F.char_length("formatted").cast("long").alias("chars"))
    # the longest example is the last; the others bring only their trained text
    tail = rows.select("conv_id", "example", "own", "chars", "formatted").groupBy("conv_id").agg(last.alias("formatted"), F.array_sort(F.collect_list("own")).alias("owns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("owns", lambda o: o["x"]), "")
    turns = parse(F.col("formatted"))
    out = tail.select("conv_id", "formatted_chars", turns.alias("turns"), loss.alias("loss"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
