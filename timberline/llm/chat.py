"""Chat formatting: every participant's perspective on a dialogue.

For each participant of a conversation the dialogue is rendered once more, with
that speaker as the assistant and all others as named users; only what the
speaker says is trained on. A perspective is one row with the whole dialogue
and the ranges of its mask. Conversations of more turns than ``PART_TURNS`` are
rendered in consecutive parts of whole turns, by the number of the turn, so that
none needs a task or a row of its own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.session import materialize

#: Role that gives context and is no participant.
SYSTEM = "system"
#: Speaker of turns without a role.
NOBODY = "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers in one part of a dialogue.
PART_TURNS = 512


def escaped(text: Column) -> Column:
    """Text in which no marker can be read: a backslash breaks up "<|" and doubles itself after "<"."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def named(role: Column) -> Column:
    """A role on one line, without markers or white space."""
    return F.regexp_replace(escaped(role), r"\s", "_")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, speaker, part, n_turns, n_trained, rendered, mask)``.

    One row for each participant of a conversation and part of it.
    ``rendered`` holds the messages in the order of their turns (then of role and
    text), each between its markers; ``mask`` the ranges, in code points of
    ``rendered`` and ends exclusive, that are trained on: text and end marker of
    the speaker's own messages. A marker inside a text or role is broken up
    by a backslash, and white space in a role becomes an underscore, so that no
    message can pass for another one. System turns stay system turns and
    are in every perspective; a conversation of system turns only has none.
    ``part`` is the turn divided by ``part_turns``, downwards; parts without a turn
    are left out. Null text is empty, a null role is the participant ``unknown``, a
    null turn comes first in part 0, null conversation ids are one conversation,
    repeated turns are rendered as often as they come. Other columns are not carried.
    """
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit(NOBODY)).alias("by"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    ).withColumn("part", F.floor(F.coalesce("turn", F.lit(0)) / part_turns).cast("long"))
    speakers = said.filter(F.col("by") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("by").alias("speaker")).distinct()
    # written out, so that both sides of the join are plain exchanges and a hot conversation can be split
    speakers = materialize(speakers)
    both = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.col("by") == F.col("speaker")
    role = F.when(own, "assistant").when(F.col("by") == SYSTEM, SYSTEM).otherwise("user")
    other = F.when(~own & (F.col("by") != SYSTEM), F.concat(F.lit(" name="), named(F.col("by"))))
    head = F.concat(F.lit(START), role, F.coalesce(other, F.lit("")), F.lit("\n"))
    message = F.struct("turn", "by", "text", head.alias("head"), F.concat(escaped(F.col("text")), F.lit(END)).alias("body"), own.alias("own"))
    grouped = both.groupBy("conv_id", "speaker", "part").agg(F.sort_array(F.collect_list(message)).alias("m"))
    nothing = F.array().cast("array<struct<start: long, end: long>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("mask"))

    def step(acc: Column, m: Column) -> Column:
        begins = acc["at"] + F.length(m["head"])
        ends = begins + F.length(m["body"])
        mine = F.array(F.struct(begins.cast("long").alias("start"), ends.cast("long").alias("end")))
        return F.struct(ends.cast("long").alias("at"), F.when(m["own"], F.concat(acc["mask"], mine)).otherwise(acc["mask"]).alias("mask"))

    return grouped.select(
        "conv_id", "speaker", "part", F.size("m").cast("long").alias("n_turns"),
        F.size(F.filter("m", lambda m: m["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["body"])), "").alias("rendered"),
        F.aggregate("m", start, step)["mask"].alias("mask"),
    )


def digest(perspectives: DataFrame) -> DataFrame:
    """The same with the mask as text, ``start:end`` joined by commas."""
    spans = F.transform("mask", lambda r: F.concat_ws(":", r["start"], r["end"]))
    return perspectives.withColumn("mask", F.array_join(spans, ","))


#: ``digest`` of ``rotate`` in DuckDB's SQL.
SQL = f"""
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '{NOBODY}') AS said_by, coalesce(text, '') AS said,
    CAST(floor(coalesce(turn, 0) / {PART_TURNS}) AS BIGINT) AS part
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id AS c, said_by AS speaker FROM said WHERE said_by <> '{SYSTEM}'
), marked AS (
  SELECT *, said_by = speaker AS own,
    CASE WHEN said_by = speaker THEN 'assistant' WHEN said_by = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role,
    CASE WHEN said_by <> speaker AND said_by <> '{SYSTEM}'
      THEN ' name=' || regexp_replace(regexp_replace(said_by, '<(\\\\*)\\|', '<\\\\\\1|', 'g'), '\\s', '_', 'g') ELSE '' END AS name,
    regexp_replace(said, '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '<|im_end|>' || chr(10) AS body
  FROM said JOIN speakers ON conv_id IS NOT DISTINCT FROM c
), headed AS (
  SELECT *, '{START}' || role || name || chr(10) AS head FROM marked
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, said_by, said ROWS UNBOUNDED PRECEDING
  ) AS ends FROM headed
)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_trained,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, said_by, said) AS rendered,
  coalesce(string_agg(CAST(ends - length(body) AS BIGINT) || ':' || CAST(ends AS BIGINT), ',' ORDER BY ends) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, part
"""
