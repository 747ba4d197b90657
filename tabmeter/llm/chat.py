"""Chat formatting in budgeted windows, in DataFrame operations only.

The tokens of the turns before a turn, a prefix sum, say which stretch of the conversation
it starts in; turns that start and end in one stretch share a window, and a turn that
crosses into the next stretch has a window of its own. So windows are made of whole turns,
need no state besides the sum, and fit the budget unless one turn alone does not. Each
window repeats the system turn and the last few turns before it, whose texts are not
trained on again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values of the template: what opens and closes a turn.
OPEN, CLOSE = "<s>", "</s>\n"
#: Strings that may steer a model, and the letters that stand for their first characters.
CONTROL = (("<", "l", r"<(?=/?s>|\|)"), ("[", "b", r"\[(?=/?INST\])"))
BUDGET = 512  # tokens of a window
HISTORY, HISTORY_TOKENS = 2, 128  # turns that a window repeats at most, and their tokens
TURN_TOKENS = 4  # of the template, for each turn
TRAINED, SYSTEM = "assistant", "system"


def escape(text: Column) -> Column:
    """The text with no control string in it; reversible."""
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for _, letter, pattern in CONTROL:
        text = F.regexp_replace(text, F.lit(pattern), F.lit("\\\\" + letter))
    return text


def unescape(text: Column) -> Column:
    for first, letter, _ in CONTROL:
        text = F.replace(text, F.lit("\\" + letter), F.lit(first))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """A count that grows with the tokens of any vocabulary: words, and four for the template."""
    return F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")) + F.lit(TURN_TOKENS)


def format_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS
) -> DataFrame:
    """(conv_id, window, text, loss, n_repeated, n_turns, n_tokens) of `conversations`
    (conv_id, turn, role, text).

    `text` is the window as the template writes it, `loss` the stretches (start, length, in
    characters from 0) to train on: each assistant text in the first window it is in. The
    first `n_repeated` of its `n_turns` turns are repeated: the system turn, if the
    conversation begins with one, then up to `history` turns of together at most
    `history_tokens`. `n_tokens` exceeds the budget only where the system turn or a single
    turn leaves no room. Turns are ordered by turn, role and text; null texts and roles are
    empty; rows without a conv_id are one conversation; repeated rows are turns of their own.
    An empty table gives no windows; other columns are not read.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("said"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    body, head = escape(F.col("said")), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    turns = rows.select(
        "conv_id",
        F.row_number().over(order).alias("at"),
        (F.col("role") == TRAINED).alias("trained"),
        ((F.row_number().over(order) == 1) & (F.col("role") == SYSTEM)).alias("system"),
        tokens(F.col("said")).alias("cost"),
        F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"),
        body.alias("body"),
    )
    by_turn = Window.partitionBy("conv_id").orderBy("at")
    turn = F.struct("head", "body", "cost")
    cost = F.when(F.col("system"), 0).otherwise(F.col("cost"))
    past = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumns(
        {
            "before": F.coalesce(F.sum(cost).over(past), F.lit(0)),
            "first": F.first(F.when(F.col("system"), turn), ignorenulls=True).over(past),
            "recent": F.collect_list(F.when(~F.col("system"), turn)).over(by_turn.rowsBetween(-history, -1)),
        }
    )
    room = F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.coalesce("first.cost", F.lit(0)))
    crosses = ~F.col("system") & (F.pmod("before", room) + F.col("cost") > room)
    grouped = (
        placed.withColumns({"stretch": F.floor(F.col("before") / room), "crosses": crosses})
        .groupBy("conv_id", "stretch", "crosses")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "trained", "head", "body", "cost"))).alias("own"),
            F.min_by("recent", "at").alias("recent"),
            F.min_by("first", "at").alias("first"),
        )
    )

    def recall(done: Column, turn: Column) -> Column:
        """Puts a turn before those recalled, as long as they fit together."""
        fits = done["going"] & (done["cost"] + turn["cost"] <= history_tokens)
        return F.named_struct(
            F.lit("n"), done["n"] + fits.cast("int"),
            F.lit("cost"), done["cost"] + F.when(fits, turn["cost"]).otherwise(0),
            F.lit("going"), fits,
        )

    none = F.named_struct(F.lit("n"), F.lit(0), F.lit("cost"), F.lit(0), F.lit("going"), F.lit(True))
    n_recent = F.aggregate(F.reverse("recent"), none, recall)["n"]
    # a first window holds the system turn itself; later ones repeat it
    repeated = F.concat(
        F.when(F.col("first").isNull(), F.array().cast("array<struct<head:string,body:string,cost:int>>")).otherwise(F.array("first")),
        F.expr("slice(recent, greatest(size(recent) - n_recent, 0) + 1, n_recent)"),
    )
    turn_type = "array<struct<trained:boolean,head:string,body:string,cost:int>>"

    def plain(turn: Column, trained: Column) -> Column:
        return F.named_struct(F.lit("trained"), trained, F.lit("head"), turn["head"], F.lit("body"), turn["body"], F.lit("cost"), turn["cost"])

    def stretch(done: Column, turn: Column) -> Column:
        """Adds a turn's characters, and if it is trained on, its text to the loss."""
        begin = done["end"] + F.char_length(turn["head"])
        size = F.char_length(turn["body"])
        span = F.named_struct(F.lit("start"), begin, F.lit("length"), size)
        return F.named_struct(
            F.lit("end"), begin + size + F.lit(len(CLOSE)),
            F.lit("spans"), F.when(turn["trained"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]),
        )

    nothing = F.named_struct(F.lit("end"), F.lit(0), F.lit("spans"), F.array().cast("array<struct<start:int,length:int>>"))
    window = F.row_number().over(Window.partitionBy("conv_id").orderBy("stretch", "crosses")) - 1
    return (
        grouped.withColumn("n_recent", n_recent)
        .withColumn("repeated", repeated)
        .select(
            "conv_id",
            window.cast("bigint").alias("window"),
            F.size("repeated").alias("n_repeated"),
            F.concat(
                F.transform("repeated", lambda t: plain(t, F.lit(False))), F.transform("own", lambda t: plain(t, t["trained"]))
            ).cast(turn_type).alias("turns"),
        )
        .select(
            "conv_id",
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("text"),
            F.aggregate("turns", nothing, stretch)["spans"].alias("loss"),
            "n_repeated",
            F.size("turns").alias("n_turns"),
            F.aggregate("turns", F.lit(0), lambda sum_, t: sum_ + t["cost"]).alias("n_tokens"),
        )
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, trained): what windows say, read from their texts alone: the
    turns (role, text) that they don't repeat, and the texts under the loss."""
    marked = F.filter(F.split("text", CLOSE), lambda x: x != "")
    body = F.transform(marked, lambda x: F.substring(x, len(OPEN) + 1, 2**30))
    turns = F.transform(
        body,
        lambda x: F.named_struct(
            F.lit("role"), unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("\\n"), F.lit("\n"))),
            F.lit("text"), unescape(F.substring(x, F.char_length(F.substring_index(x, "\n", 1)) + 2, F.lit(2**30))),
        ),
    )
    said = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select(
        "conv_id",
        "window",
        turns.alias("turns"),
        "n_repeated",
        said.alias("trained"),
        F.char_length("text").alias("chars"),
    ).withColumn("turns", F.expr("slice(turns, n_repeated + 1, size(turns))")).drop("n_repeated")


def chat_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back
    from the windows of `conversations` and of conversation -1, whose texts are control
    strings."""
    control = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', '{control}'), (-1L, 1L, 'assistant', '{control}') AS probe(conv_id, turn, role, text)"
    )
    given = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    windows = read_windows(format_windows(given.unionAll(probe)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = windows.select(
        "conv_id", "window", "chars", F.size("turns").alias("n"), lines.alias("lines"), F.array_join("trained", "").alias("trained")
    )
    whole = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "lines", "trained"))).alias("all"),
        F.sum("chars").alias("formatted_chars"),
    )
    trained = F.array_join(F.col("all.trained"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode(F.array_join(F.col("all.lines"), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(trained).cast("bigint").alias("loss_chars"),
        F.sha2(F.encode(trained, "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
