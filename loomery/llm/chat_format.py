"""Chat formatting from event logs, with DataFrame functions only.

An event is (conv_id, seq, event, turn, role, text). Events of a conversation are taken by seq: ``message`` opens a
turn with a text, ``delta`` appends to its turn, ``edit`` replaces its turn's text so far, ``regenerate`` discards
its turn and all later turns as they stood and opens the turn anew with its text. The fold is relational: an event
is superseded when a later regenerate names its turn or an earlier one, or a later edit names its turn; what is left
is put together by seq. All windows and aggregates share one exchange by conv_id.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn, in order of turn. Control strings inside
roles and texts (``CONTROLS``) get a backslash after their first character, and where such a string already carries
backslashes there, one more; so no control string stands in a formatted text but the template's own, and removing
one backslash restores the text. In roles, newlines and backslashes are further escaped as \\n and \\\\.

Null text and null role count as empty, an unknown event as a message. Null turns come first, a null conv_id is a
conversation of its own. Events with equal seq are ordered by turn, event, role and text; repeated rows count each.
Conversations exist as far as they have events, so an empty table gives an empty one. Other columns are ignored.
A conversation is one value of the output, hence its turns meet in one task; nothing else of the table does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, STOP = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates and tokenizers treat as control, fixed values. No tail holds a first character.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_TAILS = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"
ESCAPE = (r"([<\[])(\\*)" + _TAILS, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _TAILS, r"$1$2$3")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    # \\ and \n are read from the left: a doubled backslash is parked on a character that cannot come from escaping
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id and its final messages, an array of (turn, role, text) in order of turn."""
    e = events.select("conv_id", "seq", "turn", F.coalesce("event", F.lit("message")).alias("event"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("seq", "turn", "event", "role", "text")]
    e = e.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    later = Window.partitionBy("conv_id").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    lowest = F.min(F.when(F.col("event") == "regenerate", F.coalesce("turn", F.lit(-(1 << 62))))).over(later)
    e = e.withColumn("redone", lowest).where(F.col("redone").isNull() | (F.col("redone") > F.coalesce("turn", F.lit(-(1 << 62)))))
    same = Window.partitionBy("conv_id", "turn").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    e = e.withColumn("edited", F.max((F.col("event") == "edit").cast("int")).over(same)).withColumn("text", F.when(F.coalesce("edited", F.lit(0)) == 0, F.col("text")).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("at", "role", "text")))
    turns = e.groupBy("conv_id", "turn").agg(parts.alias("parts"))
    # the role is the last one that the turn's events state
    stated = F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r != "")
    turns = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.try_element_at(stated, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")).alias("m"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))


def render(folded: DataFrame) -> DataFrame:
    """conv_id and the formatted conversation."""
    one = lambda m: F.concat(F.lit(START), _role_out(m["role"]), F.lit("\n"), escape(m["text"]), F.lit(STOP + "\n"))
    return folded.select("conv_id", F.array_join(F.transform("messages", one), "").alias("formatted"))


def _blocks(formatted: Column) -> Column:
    """What stands between the turns' start marks, one string a turn."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))


def _body(block: Column, head: Column) -> Column:
    """A block's text, unescaped; head: characters of its role and the newline."""
    return unescape(F.substring(block, head + 1, F.length(block) - head - len(STOP) - 1))


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""

    def turn(b: Column) -> Column:
        cut = F.locate("\n", b)
        return F.struct(_role_in(F.substring(b, F.lit(1), cut - 1)).alias("role"), _body(b, cut).alias("text"))

    return F.transform(_blocks(formatted), turn)


def loss_texts(formatted: Column, role: str = "assistant") -> Column:
    """The texts under the loss mask, in order: what the given role says, unescaped. Each is read from its own block."""
    own = F.filter(_blocks(formatted), lambda b: F.startswith(b, F.lit(role + "\n")))
    return F.transform(own, lambda b: _body(b, F.lit(len(role) + 1)))


def loss_spans(rendered: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, start, length in characters of each text under the loss mask in ``formatted``, still escaped; a row each."""
    head = len(role) + 1
    blocks = rendered.select("conv_id", F.posexplode(F.split("formatted", r"<\|im_start\|>", -1)).alias("at", "block"))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum(F.length("block") + len(START)).over(before), F.lit(0)) + head)
    return blocks.where(F.startswith("block", F.lit(role + "\n"))).select("conv_id", "start", (F.length("block") - head - len(STOP) - 1).cast("bigint").alias("length"))


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log of messages; rows that share a turn are turns of their own, in order of role and text."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.select("conv_id", at.alias("seq"), at.alias("turn"), F.lit("message").alias("event"), "role", "text")


def digests(rendered: DataFrame) -> DataFrame:
    """What each formatted conversation says, read back from it."""
    turns = rendered.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return turns.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
