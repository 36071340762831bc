"""Preference formatting: the shared turns of two conversations once, and both completions with masks."""

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE = "<|%s|>\n", "<|end|>\n"
TRAINED = "assistant"


def render(role: Column, text: Column) -> Column:
    """A turn as text; a null role is ``unknown``, a null text empty."""
    before, after = OPEN.split("%s")
    return F.concat(F.lit(before), F.coalesce(role, F.lit("unknown")), F.lit(after), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def _numbered(turns: DataFrame, side: str) -> DataFrame:
    """Turns by their place in the conversation; ties of ``turn`` by role and text, nulls first."""
    w = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    return turns.select("pair_id", F.row_number().over(w).alias("place"), F.struct("role", "text").alias(side))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, trained: str = TRAINED) -> DataFrame:
    """One row per pair from two tables of (pair_id, turn, role, text).

    The longest common prefix of turns (equal role and text, null equal to null) is rendered
    once as ``prompt``. ``chosen`` and ``rejected`` are the rest of either conversation, with
    ``chosen_mask`` and ``rejected_mask``: [start, length] in characters of what is learned, the text of
    turns of the ``trained`` role with its end mark. Also the number of turns of each part.

    The two sides meet on (pair, place), and the prefix ends at the smallest place at which they
    differ: a partial aggregate. What is gathered is one pair's own turns. A pair with one
    side only has an empty other side and an empty prompt; rows without pair_id are left out,
    as they belong to no pair; turns that are null come first; repeated turns are turns. No
    rows give no rows, and other columns are not read.
    """
    a = _numbered(chosen.where("pair_id is not null"), "c")
    b = _numbered(rejected.where("pair_id is not null"), "r")
    both = a.join(b, ["pair_id", "place"], "full")
    same = F.col("c").isNotNull() & F.col("r").isNotNull() & F.expr("c.role <=> r.role and c.text <=> r.text")

    def part(side: str, keep: Column) -> Column:
        return F.when(F.col(side).isNotNull() & keep, F.struct("place", f"{side}.role", f"{side}.text"))

    per = both.groupBy("pair_id").agg(
        F.min(F.when(~same, F.col("place"))).alias("split"),
        F.sort_array(F.collect_list(part("c", F.lit(True)))).alias("c"),
        # equal turns are held once
        F.sort_array(F.collect_list(part("r", ~same))).alias("r"),
        F.sort_array(F.collect_list(F.when(same, F.col("place")))).alias("twins"),
    )
    split = F.coalesce("split", F.lit(2**31 - 1))
    prompt = F.filter("c", lambda t: t.place < split)
    won = F.filter("c", lambda t: t.place >= split)
    # after the split, turns that happen to be equal again belong to both sides
    again = F.filter("c", lambda t: (t.place >= split) & F.array_contains("twins", t.place))
    lost = F.sort_array(F.concat(F.col("r"), again))
    out = per.select("pair_id", prompt.alias("p"), won.alias("w"), lost.alias("l"))

    def text(turns: str) -> Column:
        return F.array_join(F.transform(turns, lambda t: render(t.role, t.text)), "")

    def mask(turns: str) -> Column:
        head = F.length(F.lit(OPEN)) - 2
        own = F.transform(
            turns,
            lambda t: F.struct(
                F.coalesce(t.role == trained, F.lit(False)).alias("learn"),
                (head + F.length(F.coalesce(t.role, F.lit("unknown")))).cast("long").alias("head"),
                (F.length(F.coalesce(t.text, F.lit(""))) + F.length(F.lit(CLOSE))).cast("long").alias("body"),
            ),
        )
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("spans"))
        step = lambda s, t: F.struct(
            (s.at + t.head + t.body).alias("at"),
            F.when(t.learn, F.concat(s.spans, F.array(F.array(s.at + t.head, t.body)))).otherwise(s.spans).alias("spans"),
        )
        return F.aggregate(own, start, step, lambda s: s.spans)

    return out.select(
        "pair_id",
        text("p").alias("prompt"),
        text("w").alias("chosen"),
        text("l").alias("rejected"),
        mask("w").alias("chosen_mask"),
        mask("l").alias("rejected_mask"),
        F.size("p").alias("prompt_turns"),
        F.size("w").alias("chosen_turns"),
        F.size("l").alias("rejected_turns"),
    )


def swapped_answers(conversations: DataFrame, trained: str = TRAINED) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from (conv_id, turn, role, text): a conversation up to its last answer is chosen,
    the same with the last answer of its neighbour (2k and 2k + 1) is rejected.

    Without an answer of the neighbour the rejected side ends before it; without an own
    answer both sides are the whole conversation. The last answer has the greatest turn, of equal turns
    the greatest text; turns that are null come before all others, and nulls before texts. Repeated rows are turns
    of their own. Rows without conv_id belong to no conversation and are left out; other columns are not read; no rows give no rows.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    is_answer = F.col("role") == trained
    last = turns.groupBy("conv_id").agg(F.max(F.when(is_answer, F.struct("turn", "text"))).alias("x"))
    last = last.select(F.col("conv_id").alias("conv"), F.col("x.turn").alias("last_turn"), F.col("x.text").alias("answer"), F.col("x").isNotNull().alias("has"))
    chosen = turns.join(last.select("conv", "last_turn", "has"), F.expr("conv_id = conv")).where("not has or turn is null or turn <= last_turn")
    chosen = chosen.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text", "last_turn", "has")
    kept = chosen.where("not has or turn < last_turn or (turn is null and last_turn is not null)").select("pair_id", "turn", "role", "text")
    neighbour = F.col("conv") + 1 - 2 * F.pmod("conv", F.lit(2))
    given = last.where("has").select(neighbour.alias("pair_id"), F.lit(trained).alias("role"), F.col("answer").alias("text"))
    given = given.join(last.where("has").select(F.col("conv").alias("pair_id"), F.col("last_turn").alias("turn")), "pair_id")
    return chosen.drop("last_turn", "has"), kept.unionByName(given)
