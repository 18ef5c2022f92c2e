"""Chat formatting in budgeted windows (DataFrame operations only).

A turn costs its markers and a token per four bytes. Prefix sums of the costs, over chunks of CHUNK turn numbers and then
over the chunks' totals, give each turn a start in its conversation. With W tokens left of the budget beside the system turn
and the history, a grid of step W cuts the conversation: the turns that lie within a cell are one span, and a turn that
crosses the cell's end is a span of its own, so every span is found from the turn's own start, without going through
the turns in order. A window is the system turn, the history (the turns that start within the last HISTORY tokens before the
span) and the span. The loss mask holds the assistant's texts of the span; what a window repeats is masked.

A turn is written as <turn ROLE>TEXT</turn>. Inside roles and texts a backslash becomes \\b, < becomes \\l and, in roles, >
becomes \\g, so no text can hold a marker, and unescaping in the other order restores it.

Defined results: turns are in the order of their number, the rows of one number the system's first, then by role and text; a
null number comes first. A null text or role is empty. Rows that repeat another are turns of their own. A null
conversation is one of its own. The leading system turn is kept in all windows if it costs half of the budget at most, else
it is an ordinary turn. A turn that costs more than W has a window of its own, which may go beyond the budget (over_budget).
Window numbers ascend within a conversation, with gaps. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Tokens of a window, of its history, and of a turn's markers.
BUDGET = 1024
HISTORY = 256
MARKERS = 4
#: Turn numbers whose rows are summed together: 2 ** 10.
CHUNK_BITS = 10
TARGET = "assistant"
SYSTEM = "system"
_FIRST = -(1 << 63)


def turn_tokens(text: Column) -> Column:
    return F.lit(MARKERS).cast("long") + F.ceil(F.octet_length(text) / F.lit(4))


def escape(text: Column, role: bool = False) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit(">"), F.lit("\\g")) if role else text


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _mark(turn: Column) -> Column:
    return F.concat(F.lit("<turn "), escape(turn["role"], True), F.lit(">"), escape(turn["text"]), F.lit("</turn>"))


def _text_start(turn: Column) -> Column:
    return F.length(escape(turn["role"], True)) + F.lit(len("<turn >"))


def spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """One row a span: conv (the id in a struct, which null doesn't differ from itself), code (its number), room (W),
    first, last (its start and end), turns (start, later, role, text), where later is 0 for the leading system turn."""
    cost = turn_tokens(F.col("text"))
    rows = turns.withColumn("cost", cost).withColumn("chunk", F.shiftright("ord", CHUNK_BITS))
    chunks = rows.groupBy("conv", "chunk").agg(F.sum("cost").alias("cost"), F.min("ord").alias("ord"))
    systems = rows.where(F.col("role") == SYSTEM).groupBy("conv").agg(F.min(F.struct("ord", "text")).alias("system"))
    ahead = Window.partitionBy("conv").orderBy("chunk")
    offsets = chunks.select(
        "conv",
        "chunk",
        F.coalesce(F.sum("cost").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        (F.row_number().over(ahead) == 1).alias("leading"),
        F.first("ord").over(ahead.rowsBetween(Window.unboundedPreceding, 0)).alias("least"),
    )
    system_cost = turn_tokens(F.col("system.text"))
    kept = (F.col("system.ord") == F.col("least")) & (system_cost <= budget // 2)
    offsets = offsets.join(systems, "conv", "left").select("conv", "chunk", "offset", "leading", F.coalesce(F.when(kept, system_cost), F.lit(0)).alias("held"))
    # turns are dealt by chunk once; the window below finds them so
    order = Window.partitionBy("conv", "chunk").orderBy("ord", F.col("role") != SYSTEM, "role", "text")
    placed = rows.join(offsets, ["conv", "chunk"])
    system = (F.col("held") > 0) & F.col("leading") & (F.row_number().over(order) == 1)
    before = F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.select("conv", "role", "text", "cost", "held", system.alias("system"), (F.col("offset") + before).alias("at"))
    room = F.lit(budget - history) - F.col("held")
    start = F.when(F.col("system"), 0).otherwise(F.col("at") - F.col("held"))
    end = F.when(F.col("system"), 0).otherwise(start + F.col("cost"))
    placed = placed.select("conv", "role", "text", "system", "held", room.alias("room"), start.alias("start"), end.alias("end"))
    cell = F.expr("start div room")
    code = cell * 2 + F.when(F.col("system") | (F.expr("(end - 1) div room") == cell), 0).otherwise(1)
    turn = F.struct("start", (~F.col("system")).cast("int").alias("later"), "role", "text")
    return placed.groupBy("conv", code.alias("code")).agg(
        F.first("room").alias("room"), F.first("held").alias("held"), F.min("start").alias("first"), F.max("end").alias("last"), F.sort_array(F.collect_list(turn)).alias("turns")
    )


def format_conversations(
    rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row a window: conv_id, window, formatted, loss_spans (start, length in characters), n_turns (new ones),
    n_repeated (turns ahead of them that an earlier window has), tokens, over_budget."""
    if not 0 <= history <= budget // 4:
        raise ValueError("the history may take a quarter of the budget at most")
    turns = rows.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(_FIRST)).alias("ord"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    held = materialize(spans(turns, budget, history), "chat-spans")
    # a later span's history starts at its own start less `history`; that lies at this span's end or later
    tail = F.filter("turns", lambda t: (t["later"] == 1) & (t["start"] >= F.col("last") - history))
    reached = F.expr(f"sequence(code + 1, greatest(code + 1, 2 * ((last + {history}) div room) + 1))")
    tails = held.select("conv", tail.alias("tail"), F.explode(reached).alias("code")).where(F.size("tail") > 0)
    past = tails.groupBy("conv", "code").agg(F.sort_array(F.flatten(F.collect_list("tail"))).alias("past"))
    first = held.where(F.exists("turns", lambda t: t["later"] == 0)).select("conv", F.col("turns")[0].alias("system"))
    joined = held.join(past, ["conv", "code"], "left").join(first, "conv", "left")
    recent = F.filter(F.coalesce("past", F.expr("array()").cast(held.schema["turns"].dataType)), lambda t: t["start"] >= F.col("first") - history)
    own_system = F.exists("turns", lambda t: t["later"] == 0)
    repeated = F.concat(F.when(F.col("system").isNotNull() & ~own_system, F.array("system")).otherwise(F.expr("array()").cast(held.schema["turns"].dataType)), recent)
    whole = joined.withColumn("repeated", repeated).withColumn("members", F.concat("repeated", "turns"))

    def step(acc: Column, turn: Column) -> Column:
        start = acc["at"] + _text_start(turn)
        size = F.length(escape(turn["text"])).cast("long")
        span = F.struct(start.cast("long").alias("start"), size.alias("length"))
        loss = (turn["role"] == TARGET) & (acc["n"] >= F.size("repeated"))
        return F.struct(
            (start + size + len("</turn>")).cast("long").alias("at"), (acc["n"] + 1).alias("n"), F.when(loss, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans")
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"), F.expr("array()").cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    tokens = F.aggregate("members", F.lit(0).cast("long"), lambda acc, t: acc + turn_tokens(t["text"]))
    return whole.select(
        F.col("conv.id").alias("conv_id"),
        F.col("code").alias("window"),
        F.array_join(F.transform("members", _mark), "").alias("formatted"),
        F.aggregate("members", zero, step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.size("turns").alias("n_turns"),
        F.size("repeated").alias("n_repeated"),
        tokens.alias("tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """The windows with their new turns (role, text) and the texts under the loss mask, read back from `formatted`."""
    pattern = F.lit("<turn ([^>]*)>([^<]*)</turn>")
    roles, texts = (F.regexp_extract_all("formatted", pattern, F.lit(k)) for k in (1, 2))
    turns = F.arrays_zip(roles.alias("role"), texts.alias("text"))
    turns = F.transform(turns, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.withColumn("turns", F.slice(turns, F.col("n_repeated") + 1, F.greatest("n_turns", F.lit(0)))).withColumn("loss", loss)


def digests(windows: DataFrame) -> DataFrame:
    """One row a conversation, from its windows: the digests of its turns and of its loss texts. A digest is of the whole
    conversation, so that its text has to fit into one row."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = read_turns(windows).select(
        F.struct("conv_id").alias("conv"), F.size("turns").alias("n"), F.length("formatted").alias("chars"), F.struct("window", F.array_join(said, "").alias("said"), F.array_join("loss", "").alias("loss")).alias("part")
    )
    whole = rows.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    said, loss = F.array_join("parts.said", ""), F.array_join("parts.loss", "")
    return whole.select(
        F.col("conv.conv_id").alias("conv_id"),
        "n_turns",
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
