"""Preference pairs of conversations as a prompt and two masked completions.

The longest common prefix of turns of the chosen and the rejected conversation is rendered
once, as the prompt; what follows is each one's completion. The mask of a completion holds
the parts that a loss counts: what assistant turns say, with their end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.llm.common import free_names

#: Marks of a turn (fixed values of the template), and the role whose words count.
BEGIN, END, ROLE = "<|im_start|>", "<|im_end|>", "assistant"
#: A mark's opening inside a text is parted, so that no text can forge a turn.
MARK, PARTED = "<|", "< |"


def turns_of(turns: Column) -> Column:
    """Array of (role, text); nulls are empty strings."""
    return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns of ``a`` and ``b`` are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) == F.element_at(b, i))
    differs = F.array_position(same, False)
    return F.when(n == 0, F.lit(0)).when(differs == 0, n).otherwise((differs - 1).cast("int"))


def _clean(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(PARTED))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), _clean(turn["role"]), F.lit("\n"))


def _tail(turn: Column) -> Column:
    return F.concat(_clean(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """Spans (begin, stop) in code points of a rendering that a loss counts."""
    sizes = F.transform(turns, lambda t: F.struct((t["role"] == ROLE).alias("counts"), F.char_length(_head(t)).alias("head"), F.char_length(_tail(t)).alias("tail")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,stop:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + t["head"]
        stop = body + t["tail"]
        span = F.array(F.struct(body.alias("begin"), stop.alias("stop")))
        return F.struct((stop + 1).alias("at"), F.when(t["counts"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (chosen, rejected: arrays of (role, text)) with prompt, completions and masks instead.

    New columns: n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask; the
    others stay. A further column that has the name of a new one gets underscores before it.

    Defined cases: null roles, texts and conversations are empty; of equal conversations all is
    prompt and both completions are empty; where one conversation begins the other, its
    completion is empty; an empty table gives no rows.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    clash = [c for c in pairs.columns if c.lower() in ("n_prompt_turns", "prompt", "chosen_mask", "rejected_mask")]
    pairs = pairs.withColumnsRenamed(dict(zip(clash, free_names(pairs, *clash))))
    whole = pairs.withColumns({c: F.coalesce(turns_of(F.col(c)), empty) for c in ("chosen", "rejected")})
    whole = whole.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    out = whole.withColumn("prompt", render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))))
    out = out.withColumns({c: rest(c) for c in ("chosen", "rejected")})
    return out.withColumns({"chosen_mask": mask(F.col("chosen")), "rejected_mask": mask(F.col("rejected")), "chosen": render(F.col("chosen")), "rejected": render(F.col("rejected"))})


def reply_swaps(turns: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected) out of plain conversations (conv_id, turn, role, text).

    Chosen is the conversation up to its last assistant turn; rejected has in that turn's
    place the last reply of the conversation whose id differs in the lowest bit, or an empty
    reply where there is none. Both conversations come together in one grouping by
    the id's other bits. Conversations without an assistant turn, and turns without an id,
    give no pair. Turns with the same number are in order of role and text.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    both = rows.groupBy(F.shiftright("conv_id", 1).alias("pair")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role", "text"))).alias("all"))
    of = lambda bit: F.filter("all", lambda t: t["conv_id"].bitwiseAND(F.lit(1).cast("long")) == bit)
    sides = both.select(F.explode(F.array(*[F.struct(F.shiftleft("pair", 1).bitwiseOR(F.lit(k).cast("long")).alias("conv_id"), of(k).alias("own"), of(1 - k).alias("other")) for k in (0, 1)])).alias("s")).select("s.*")
    # 1-based place of the last reply, 0 where there is none
    last = lambda c: F.coalesce(F.array_max(F.transform(c, lambda t, i: F.when(t["role"] == ROLE, i + 1))), F.lit(0))
    placed = sides.withColumns({"k": last("own"), "m": last("other")}).where("k > 0")
    said = F.when(F.col("m") > 0, F.element_at("other", F.when(F.col("m") > 0, F.col("m")).otherwise(1))["text"]).otherwise("")
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return placed.select(
        "conv_id",
        plain(F.slice("own", F.lit(1), F.col("k"))).alias("chosen"),
        F.concat(plain(F.slice("own", F.lit(1), F.col("k") - 1)), F.array(F.struct(F.lit(ROLE).alias("role"), said.alias("text")))).alias("rejected"),
    )


def branches(turns: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected) out of plain conversations (conv_id, turn, role, text), which part somewhere.

    Chosen is the conversation up to its last assistant turn. Rejected leaves it after a number
    of turns that hangs on the id, and goes on with the later turns, up to the last assistant
    one, of the conversation whose id differs in the lowest bit. How much they share is left
    to see: turns behind the parting may be equal, and the other conversation may have none.

    Both conversations of a pair come together in one grouping by the id's other bits, so
    memory goes with the longest two conversations. Conversations without an assistant turn,
    and turns without an id, give no pair; null roles and texts are empty; turns with the same
    number are in order of role and text; an empty table gives no rows.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    both = rows.groupBy(F.shiftright("conv_id", 1).alias("pair")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role", "text"))).alias("all"))
    of = lambda bit: F.filter("all", lambda t: t["conv_id"].bitwiseAND(F.lit(1).cast("long")) == bit)
    sides = both.select(F.explode(F.array(*[F.struct(F.shiftleft("pair", 1).bitwiseOR(F.lit(k).cast("long")).alias("conv_id"), of(k).alias("own"), of(1 - k).alias("other")) for k in (0, 1)])).alias("s")).select("s.*")
    last = lambda c: F.coalesce(F.array_max(F.transform(c, lambda t, i: F.when(t["role"] == ROLE, i + 1))), F.lit(0))
    placed = sides.withColumns({"k": last("own"), "m": last("other")}).where("k > 0").withColumn("at", F.pmod(F.col("conv_id") * 7 + 3, F.col("k")).cast("int"))
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    behind = F.slice("other", F.col("at") + 1, F.greatest(F.col("m") - F.col("at"), F.lit(0)))
    return placed.select("conv_id", plain(F.slice("own", F.lit(1), F.col("k"))).alias("chosen"), F.concat(plain(F.slice("own", F.lit(1), F.col("at"))), plain(behind)).alias("rejected"))
