"""Chat formatting into budgeted windows with a loss mask.

A conversation's turns are put in order and their token counts summed up by a window
function. Prefix sums cut it into spans of whole turns within the budget; each span becomes
a window: the system turn, then as much of the turns before as the history share and the
rest of the budget allow, then the span. Only assistant texts of the span itself are
targets, so a target that history repeats is masked there, and each assistant text is
learned from once. A window passes the budget only if its system turn and a single turn
do: that turn is a span of its own, stays whole and gets no history.

Template: ``<|im_start|>role\\n text <|im_end|>\\n``. Inside roles and texts a backslash is
written ``\\s`` and the characters ``<|`` are written ``\\o``; a line break inside a role
is written ``\\n``. No control string can occur in escaped text, and unescaping undoes it.

Built-in expressions only. Tokens are estimated: a quarter of the characters, and five for
a turn's marks. Null roles and texts count as empty; turns with equal numbers are put in
order by role and text, all stay (repeated rows too), and null turn numbers come first. Rows
with a null conv_id are one conversation. A conversation's turns meet in one row, as its
text and its digest need them in order; the work grows with their number, and that of
listing the starts of windows with its square over ``STRETCH``. Other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's marks.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window, and the share of them that history may take.
BUDGET, HISTORY = 512, 0.25
#: Characters of a token, for the built-in estimate, and tokens of a turn's marks.
CHARS, MARKS = 4, 5
#: Turns whose spans are told apart before their starts join those of the turns before.
STRETCH = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("\\o"))


def unescape(text: Column) -> Column:
    broken = F.replace(F.replace(text, F.lit("\\o"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.replace(broken, F.lit("\\s"), F.lit("\\"))


def windows(turns: DataFrame, budget: int = BUDGET, history: float = HISTORY) -> DataFrame:
    """Windows of the conversations in turns(conv_id, turn, role, text).

    Columns: conv_id, window (from 0), text, n_context (turns at its start that other
    windows hold as well or that are kept from the conversation's start), n_turns (new
    ones), n_tokens and loss (array of start, end: code points of text that are targets).
    """
    past = int(budget * history)
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    shaped = plain.select(
        "conv_id", "turn", "role", F.col("text").alias("said"),
        F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")).alias("name"),
        escape(F.col("text")).alias("text"),
        (F.ceil(F.length("text") / CHARS) + MARKS).alias("tokens"),
    )
    framed = shaped.select(
        "conv_id", "turn", "role", "said", "tokens",
        F.concat(F.lit(START), "name", F.lit("\n"), "text", F.lit(END)).alias("block"),
        (F.length("name") + len(START) + 1).alias("lead"), F.length("text").alias("chars"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = framed.withColumns({
        "number": F.row_number().over(order) - 1,
        "sum": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
        "at": F.coalesce(F.sum(F.length("block").cast("long")).over(before), F.lit(0)),
    })
    # every turn has tokens, so sums tell turns apart: how many turns before this one lie within the history share
    reach = Window.partitionBy("conv_id").orderBy("sum").rangeBetween(-past, -1)
    near = summed.withColumn("back", F.count("*").over(reach))
    fields = ("number", "block", "lead", "chars", "tokens", "sum", "at", "back")
    whole = near.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*fields, (F.col("role") == "assistant").alias("target"), (F.col("role") == "system").alias("system")))).alias("turns"))
    held = whole.selectExpr("conv_id", "turns", "size(turns) AS n", "IF(turns[0].system, 1, 0) AS held", "IF(turns[0].system, turns[0].tokens, 0L) AS kept")
    room = held.withColumn("past", F.expr(f"greatest(0L, least({past}L, {budget} - kept - 1))")).withColumn("room", F.expr(f"greatest(1L, {budget} - kept - past)"))
    # a span ends before the turn with which it would pass the room
    # starts are gathered by stretches of turns: one list that grew with each would be copied as often
    cut = room.withColumn("starts", F.expr(f"""aggregate(sequence(0, (n - held) div {STRETCH}), named_struct('at', array(held), 'base', kept),
        (a, c) -> aggregate(sequence(held + CAST(c AS int) * {STRETCH}, least(n, held + CAST(c AS int) * {STRETCH} + {STRETCH - 1})), named_struct('at', CAST(array() AS array<int>), 'base', a.base),
            (b, i) -> IF(i < n AND turns[i].sum > b.base AND turns[i].sum + turns[i].tokens - b.base > room, named_struct('at', concat(b.at, array(i)), 'base', turns[i].sum), b),
            b -> named_struct('at', concat(a.at, b.at), 'base', b.base)), a -> a.at)"""))
    spans = cut.withColumn("spans", F.expr("transform(starts, (s, k) -> named_struct('window', k, 'first', s, 'last', coalesce(get(starts, k + 1), n)))"))
    total = "turns[w.last - 1].sum + turns[w.last - 1].tokens"
    # an over-long span leaves the history less; get() and the conditions take care of spans without turns
    ended = spans.withColumn("spans", F.expr(f"""transform(spans, w -> named_struct('window', w.window, 'first', w.first, 'last', w.last, 'back', IF(w.first >= n OR w.first = held, w.first,
        w.first - size(filter(sequence(1, greatest(1, CAST(turns[w.first].back AS int))), b -> w.first - b >= held
            AND turns[w.first].sum - turns[w.first - b].sum <= least(past, {budget} - kept - ({total} - turns[w.first].sum)))))))"""))
    made = ended.withColumn("made", F.expr(f"""transform(spans, w -> named_struct('window', w.window,
        'n_context', IF(w.window = 0, 0, held + w.first - w.back), 'n_turns', w.last - w.first + IF(w.window = 0, held, 0),
        'n_tokens', kept + IF(w.back < w.last, {total} - turns[w.back].sum, 0L),
        'text', concat(array_join(transform(slice(turns, 1, held), t -> t.block), ''), array_join(transform(slice(turns, w.back + 1, w.last - w.back), t -> t.block), '')),
        'loss', IF(w.first >= w.last, CAST(array() AS array<struct<start:bigint,end:bigint>>), transform(filter(sequence(w.first, w.last - 1), i -> i < w.last AND turns[i].target AND turns[i].chars > 0),
            i -> named_struct('start', coalesce(get(turns, held).at, 0L) * held + turns[i].at - turns[w.back].at + turns[i].lead,
                'end', coalesce(get(turns, held).at, 0L) * held + turns[i].at - turns[w.back].at + turns[i].lead + turns[i].chars)))))"""))
    # Every conversation has a window. A plain explode would infer a filter on the size of made, which, pushed below
    # these projections, builds the windows twice.
    return made.select("conv_id", F.explode_outer("made").alias("w")).select("conv_id", "w.window", "w.text", "w.n_context", "w.n_turns", "w.n_tokens", "w.loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: conv_id, n_turns, turns (array of role, text) and targets (array of text), unescaped, and formatted_chars."""
    blocks = F.expr(f"filter(split(text, '<\\\\|im_end\\\\|>\\n'), b -> b <> '')")
    parts = F.transform(blocks, lambda b: F.substr(b, F.lit(len(START) + 1)))
    fresh = formatted.withColumn("fresh", F.slice(parts, F.col("n_context") + 1, F.greatest(F.size(blocks) - F.col("n_context"), F.lit(0))))
    turn = F.transform("fresh", lambda b: F.struct(
        unescape(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)).alias("text"),
    ))
    said = F.transform("loss", lambda x: unescape(F.substr("text", x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))))
    seen = fresh.select("conv_id", F.struct("window", turn.alias("turns"), said.alias("targets")).alias("w"), F.length("text").cast("long").alias("chars"))
    joined = seen.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"))
    return joined.select("conv_id", F.flatten("ws.turns").alias("turns"), F.flatten("ws.targets").alias("targets"), "formatted_chars")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, read back from its windows."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    targets = F.array_join("targets", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
