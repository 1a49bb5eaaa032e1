"""Preference pairs from conversations, as rendered segments with a training mask.

A pair is a chosen and a rejected conversation. Their longest common turn prefix is the prompt and is
rendered once; what follows on either side is that side's completion. The result has a row for each
rendered turn: joining a pair's prompt rows and one side's rows in order of ``turn`` gives the sample, and
``trained`` marks the turns that a loss counts, those of the assistant in completions.

Rows stay rows: prefixes are found by aggregation over (pair, turn) and joined back, so a conversation of
any length, and a first turn that any number of conversations share, needs no task that holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn number that a row without one has.
NO_TURN = -(2**63)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per (conv_id, turn): the least (role, text) where several exist; nulls become ``unknown`` and empty."""
    return (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("turn"),
                    F.struct(F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("said"))
            .groupBy("conv_id", "turn").agg(F.min("said").alias("said")))


def preference_segments(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair_id, part, turn, conv_id, role, text, trained, prompt_turns`` of each rendered turn.

    ``pairs`` has pair_id, chosen and rejected (ids of conversations, either may be null or name none: that
    side is then empty and nothing is common). ``part`` is prompt, chosen or rejected; prompt rows carry the chosen
    conversation's id. Turns are compared by number, role and text, and the prefix ends before the first number at
    which the sides differ or one of them has no turn. Rows without conv_id belong to no conversation.
    """
    sides = (pairs.select("pair_id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("chosen").cast("long").alias("conv_id")),
        F.struct(F.lit(1).alias("side"), F.col("rejected").cast("long").alias("conv_id")))).alias("s"))
        .select("pair_id", "s.side", "s.conv_id").where("conv_id is not null"))
    turns = turns_of(conversations).join(sides, "conv_id")
    return _segments(turns)


def _segments(turns: DataFrame) -> DataFrame:
    """``turns``: pair_id, side, conv_id, turn, said, one row for each (pair_id, side, turn)."""
    of_side = lambda side: F.max(F.when(F.col("side") == side, F.struct("conv_id", "said")))
    aligned = turns.groupBy("pair_id", "turn").agg(of_side(0).alias("chosen"), of_side(1).alias("rejected"))
    same = F.coalesce(F.col("chosen.said") == F.col("rejected.said"), F.lit(False))
    aligned = aligned.withColumn("same", same)
    ends = aligned.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("end"))
    judged = (aligned.join(ends, "pair_id")
              .withColumn("common", F.col("end").isNull() | (F.col("turn") < F.col("end"))))
    prompts = judged.where("common").groupBy("pair_id").agg(F.count(F.lit(1)).alias("prompt_turns"))
    part = lambda name, own: F.when(own.isNotNull(), F.struct(F.lit(name).alias("part"), own.alias("own")))
    rows = judged.select("pair_id", "turn", F.explode(F.when(F.col("common"), F.array(part("prompt", F.col("chosen")))).otherwise(
        F.filter(F.array(part("chosen", F.col("chosen")), part("rejected", F.col("rejected"))), lambda x: x.isNotNull()))).alias("s"))
    role = F.col("s.own.said.role")
    return (rows.join(prompts, "pair_id", "left")
            .select("pair_id", F.col("s.part").alias("part"), "turn", F.col("s.own.conv_id").alias("conv_id"), role.alias("role"),
                    rendered(role, F.col("s.own.said.text")).alias("text"),
                    ((F.col("s.part") != "prompt") & (role == "assistant")).alias("trained"),
                    F.coalesce("prompt_turns", F.lit(0)).alias("prompt_turns")))


def neighbour_preferences(conversations: DataFrame) -> DataFrame:
    """Segments of the pairs (2k, 2k + 1) of neighbouring conversation ids, the even one chosen.

    A conversation whose neighbour is absent is paired with an empty one.
    """
    return _segments(turns_of(conversations).withColumn("pair_id", F.shiftright("conv_id", 1)).withColumn("side", F.col("conv_id").bitwiseAND(1)))


def replaced_preferences(conversations: DataFrame) -> DataFrame:
    """Segments of a pair for each conversation, named by its id: chosen as it is, rejected with another answer at its end.

    The rejected side has the turns before the conversation's last assistant turn and, as that turn, the last assistant turn of the
    neighbour (the id that differs in the lowest bit). A conversation without an assistant turn, or whose neighbour has none, is
    all prompt. Equal answers are common, so then only the chosen side's later turns are completions.
    """
    turns = turns_of(conversations)
    answers = (turns.where(F.col("said.role") == "assistant").groupBy("conv_id")
               .agg(F.max(F.struct("turn", "said")).alias("last")).select("conv_id", "last.turn", "last.said"))
    others = answers.select(F.col("conv_id").bitwiseXOR(1).alias("pair_id"), F.col("conv_id").alias("other"), F.col("said").alias("answer"))
    ends = answers.select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("end")).join(others, "pair_id", "left")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit(0).alias("side"), "conv_id", "turn", "said")
    # Where nothing takes the place of an answer, both sides are the same.
    known = chosen.join(ends, "pair_id", "left")
    kept = known.where("other is null or turn < end").select("pair_id", F.lit(1).alias("side"), "conv_id", "turn", "said")
    taken = ends.where("other is not null").select("pair_id", F.lit(1).alias("side"), F.col("other").alias("conv_id"), F.col("end").alias("turn"), F.col("answer").alias("said"))
    return _segments(chosen.unionByName(kept).unionByName(taken))


#: DuckDB equivalent of ``neighbour_preferences`` over the table ``conversations``.
NEIGHBOUR_SQL = """
with said as (
  select conv_id, coalesce(turn, -9223372036854775808) as turn,
         min(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, ''))) as said
  from conversations where conv_id is not null group by all
), aligned as (
  select coalesce(c.conv_id, r.conv_id) >> 1 as pair_id, coalesce(c.turn, r.turn) as turn,
         c.conv_id as chosen_id, c.said as chosen, r.conv_id as rejected_id, r.said as rejected,
         coalesce(c.said = r.said, false) as same
  from (select * from said where conv_id & 1 = 0) c
  full join (select * from said where conv_id & 1 = 1) r on r.conv_id = c.conv_id + 1 and r.turn = c.turn
), judged as (
  select *, coalesce(turn < min(turn) filter (not same) over (partition by pair_id), true) as common from aligned
), counted as (
  select *, count(*) filter (common) over (partition by pair_id) as prompt_turns from judged
), parts as (
  select pair_id, 'prompt' as part, turn, chosen_id as conv_id, chosen as own, prompt_turns from counted where common
  union all
  select pair_id, 'chosen', turn, chosen_id, chosen, prompt_turns from counted where not common and chosen_id is not null
  union all
  select pair_id, 'rejected', turn, rejected_id, rejected, prompt_turns from counted where not common and rejected_id is not null
)
select pair_id, part, turn, conv_id, own.role as role,
       '<|' || own.role || '|>' || chr(10) || own.text || '<|end|>' || chr(10) as text,
       part <> 'prompt' and own.role = 'assistant' as trained, prompt_turns
from parts
"""

#: DuckDB equivalent of ``replaced_preferences`` over the table ``conversations``.
REPLACED_SQL = """
with said as (
  select conv_id, coalesce(turn, -9223372036854775808) as turn,
         min(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, ''))) as said
  from conversations where conv_id is not null group by all
), answers as (
  select conv_id, max(turn) as turn, arg_max(said, turn) as said from said where said.role = 'assistant' group by all
), ends as (
  select a.conv_id, a.turn as last_turn, o.conv_id as other, o.said as answer from answers a left join answers o on o.conv_id = xor(a.conv_id, 1)
), rejected as (
  select s.conv_id as pair_id, s.conv_id, s.turn, s.said from said s left join ends e using (conv_id) where e.other is null or s.turn < e.last_turn
  union all
  select conv_id, other, last_turn, answer from ends where other is not null
), aligned as (
  select coalesce(c.conv_id, r.pair_id) as pair_id, coalesce(c.turn, r.turn) as turn,
         c.conv_id as chosen_id, c.said as chosen, r.conv_id as rejected_id, r.said as rejected, coalesce(c.said = r.said, false) as same
  from said c full join rejected r on r.pair_id = c.conv_id and r.turn = c.turn
), judged as (
  select *, coalesce(turn < min(turn) filter (not same) over (partition by pair_id), true) as common from aligned
), counted as (
  select *, count(*) filter (common) over (partition by pair_id) as prompt_turns from judged
), parts as (
  select pair_id, 'prompt' as part, turn, chosen_id as conv_id, chosen as own, prompt_turns from counted where common
  union all
  select pair_id, 'chosen', turn, chosen_id, chosen, prompt_turns from counted where not common and chosen_id is not null
  union all
  select pair_id, 'rejected', turn, rejected_id, rejected, prompt_turns from counted where not common and rejected_id is not null
)
select pair_id, part, turn, conv_id, own.role as role,
       '<|' || own.role || '|>' || chr(10) || own.text || '<|end|>' || chr(10) as text,
       part <> 'prompt' and own.role = 'assistant' as trained, prompt_turns
from parts
"""
