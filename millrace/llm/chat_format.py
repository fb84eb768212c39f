"""Operator 4: chat formatting by event-sourced reconstruction, DataFrame functions only.

A conversation is a log of events (conv_id, seq, op, target, role, text). Partitioned by conversation and sorted by
sequence, the log is folded into final messages: 'message' opens a message (its id is target, or seq without one), 'delta'
appends to its target, 'edit' replaces the target's text, 'regenerate' empties the target and drops what follows it (the
messages of greater id that are open then). Then the messages are rendered.

The fold is linear in the log: what later regenerations drop is a running minimum over the conversation from its end; the
events of a message meet by its id, where its text is what the last replacement left and the deltas after it. All of that
needs one exchange, by conversation. A conversation ends as one formatted text, so it has to fit in a row.

The query turns each row of a conversation into a log that ends in the row's text: a user's message is streamed, then edited;
an assistant's is streamed, answered, regenerated and streamed anew. So every op is folded at every turn.

Template: <s>[role]text[/role] with </s> after an assistant's turn. Control strings inside a text or role are escaped
reversibly: a backslash becomes \\e, the first character of a control string becomes \\l (for <) or \\b (for [), and a ]
inside a role becomes \\c.

Null texts are empty; a null role is 'user'; rows of a null conversation form one conversation of their own; ties of seq
are ordered by role, then text, messages then by id, and repeated rows stay repeated; events of a target that isn't open are ignored, as is an unknown op;
a null seq comes first; a conversation without a message left gives no row; very long texts are kept whole; extra columns are
ignored; an empty log gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import let

OPEN, CLOSE, BOS, EOS = "[", "]", "<s>", "</s>"
#: What a text must not hold raw. Every marker of the template starts with < or [.
CONTROL = r"(/?(?:s>|SYS>)|<SYS>>|</SYS>>|\|[a-z_]+\|>)"
CONTROL_ROLE = r"(/?[A-Za-z_]{1,64}\])"


def escape(text: Column) -> Column:
    x = F.replace(text, F.lit("\\"), F.lit("\\e"))
    x = F.regexp_replace(x, "<" + CONTROL, r"\\l$1")
    return F.regexp_replace(x, r"\[" + CONTROL_ROLE, r"\\b$1")


def unescape(text: Column) -> Column:
    # Each backslash of an escaped text is followed by e, l or b, so the order below is safe.
    x = F.replace(text, F.lit("\\l"), F.lit("<"))
    x = F.replace(x, F.lit("\\b"), F.lit("["))
    return F.replace(x, F.lit("\\e"), F.lit("\\"))


_ORDER = ("seq", "role", "text", "op")


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>) from an event log with columns conv_id, seq, op, target, role, text."""
    log = events.select(
        "conv_id",
        F.col("seq").cast("long").alias("seq"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("op", F.lit("message")).alias("op"),
        F.coalesce("target", "seq").cast("long").alias("id"),
    )
    # The least id that a regeneration after this event keeps: an open message of a greater id is gone then.
    after = W.partitionBy("conv_id").orderBy(*[F.col(c).desc_nulls_last() for c in _ORDER]).rowsBetween(W.unboundedPreceding, -1)
    log = log.withColumn("kept", F.min(F.when(F.col("op") == "regenerate", F.col("id"))).over(after))
    of = log.groupBy("conv_id", "id").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "kept"))).alias("log"))

    def text(e: Column, i: Column) -> Column:
        """The text of the message that event i opens: of the last replacement after it, else its own, and the deltas since."""
        since = F.greatest(i, F.col("last"))
        first = F.when(F.col("last") > i, F.when(F.col("reset.op") == "edit", F.col("reset.text")).otherwise(F.lit(""))).otherwise(e["text"])
        more = F.filter("log", lambda x, j: (j > since) & (x["op"] == "delta"))
        return F.concat(first, F.array_join(F.transform(more, lambda x: x["text"]), ""))

    # The place of the last edit or regeneration among a message's events, -1 without one.
    last = F.size("log") - F.coalesce(F.array_position(F.transform(F.reverse("log"), lambda x: x["op"].isin("edit", "regenerate")), True), F.lit(0))
    of = of.withColumn("last", F.when(F.exists("log", lambda x: x["op"].isin("edit", "regenerate")), last).otherwise(F.lit(-1)).cast("int"))
    of = of.withColumn("reset", F.get("log", F.col("last")))
    opened = F.transform("log", lambda e, i: F.when((e["op"] == "message") & (e["kept"].isNull() | F.col("id").isNull() | (F.col("id") <= e["kept"])), F.struct(*[e[c].alias(c) for c in _ORDER[:3]], F.col("id"), text(e, i).alias("final"))))
    messages = of.select("conv_id", F.explode(F.filter(opened, lambda x: x.isNotNull())).alias("m"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("l"))
    return turns.select("conv_id", F.transform("l", lambda m: F.struct(m["role"].alias("role"), m["final"].alias("text"))).alias("turns"))


STEPS = 16  # events that a turn may take


def logged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) of conversations as an event log whose fold gives them back in order."""
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.withColumns({"id": nth.cast("long") * STEPS, "half": F.floor(F.length("text") / 2).cast("int")})
    head = F.substring("text", F.lit(1), F.col("half"))
    tail = F.substring("text", F.col("half") + 1, F.length("text"))

    def event(k: int, op: str, what: Column, who: Column | None = None, target: Column | None = None) -> Column:
        return F.struct((F.col("id") + k).alias("seq"), F.lit(op).alias("op"), (F.col("id") if target is None else target).alias("target"), (F.col("role") if who is None else who).alias("role"), what.alias("text"))

    said = F.array(event(0, "message", head), event(1, "delta", F.lit(" draft")), event(2, "edit", F.col("text")))
    answered = F.array(
        event(0, "message", F.lit("")), event(1, "delta", F.reverse(head)), event(2, "delta", F.lit(" first try")),
        event(3, "message", F.lit("again, please"), F.lit("user"), F.col("id") + 3), event(4, "regenerate", F.lit("")), event(5, "delta", head), event(6, "delta", tail),
    )
    return rows.select("conv_id", F.explode(F.when(F.col("role") == "assistant", answered).otherwise(said)).alias("e")).select("conv_id", "e.*")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(CLOSE), F.lit("\\c"))


def rendered(turns: Column) -> Column:
    """The formatted text of an array of turns."""
    def one(t: Column) -> Column:
        role = _role(t["role"])
        return F.concat(F.lit(BOS + OPEN), role, F.lit(CLOSE), escape(t["text"]), F.lit(OPEN + "/"), role, F.lit(CLOSE), F.when(t["role"] == "assistant", F.lit(EOS)).otherwise(F.lit("")))

    return F.array_join(F.transform(turns, one), "")


def parsed(formatted: Column) -> Column:
    """The turns, read back from a formatted text: the inverse of rendered()."""
    def one(piece: Column) -> Column:
        # [role]text[/role] or the same and </s>; a role holds no ].
        closed = F.when(F.endswith(piece, F.lit(EOS)), F.substring(piece, F.lit(1), F.length(piece) - len(EOS))).otherwise(piece)
        at = F.locate(CLOSE, closed)
        role = F.substring(closed, F.lit(2), at - 2)
        body = F.substring(closed, at + 1, F.length(closed) - at - F.length(role) - 3)
        return F.struct(unescape(F.replace(role, F.lit("\\c"), F.lit(CLOSE))).alias("role"), unescape(body).alias("text"))

    pieces = F.filter(F.split(formatted, BOS), lambda x: x != "")
    return F.transform(pieces, lambda p: let(p, one))


def formatted_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted) for each conversation of the log."""
    return folded(events).select("conv_id", rendered(F.col("turns")).alias("formatted"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The query's columns, read back from the formatted texts."""
    back = formatted_chats(logged(conversations)).select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        loss.alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
