"""Chat formatting by perspective rotation.

Every speaker of a conversation is the assistant once: the dialogue is rendered
with that speaker's turns as assistant turns and all others' as named user
turns, and the loss mask covers what the assistant says.  A conversation of p
speakers and t turns gives p * t segments; in order of turn they are the
rendered dialogue.  One row holds one segment, so a conversation of any length
never meets in one task; the speakers of a conversation are a pre-aggregated
distinct, joined back by conversation id.

Native only.  Defined results: roles in ``context_roles`` speak in no
perspective, their turns are rendered as they are; a null role is the speaker
'unknown'; a null text is empty; a null conversation id is a conversation of
its own; rows that repeat a turn are rendered as often as they come; control
marks inside a text are broken up; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _harmless(text: Column) -> Column:
    """The text with a space inside anything that begins like a control mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", context_roles=CONTEXT_ROLES) -> DataFrame:
    """``(conv, perspective, turn, role, name, segment, mask_start, mask_end)``.

    ``mask_start`` and ``mask_end`` bound the characters of the segment that
    count in the loss: the assistant's words and its end mark; both are 0 elsewhere.
    """
    speaker = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))
    said = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), speaker.alias("_speaker"),
                        F.col(text_col).cast("string").alias("_text"))
    speakers = (said.where(~F.col("_speaker").isin(*context_roles)).select(F.col("_conv").alias("_c"), F.col("_speaker").alias("perspective"))
                .distinct())
    both = said.join(speakers, F.col("_conv").eqNullSafe(F.col("_c")))
    role = (F.when(F.col("_speaker").isin(*context_roles), F.col("_speaker"))
            .when(F.col("_speaker") == F.col("perspective"), "assistant").otherwise("user"))
    both = both.withColumn("role", role)
    name = F.when(F.col("role") == "user", F.regexp_replace("_speaker", "[^A-Za-z0-9_-]", "_"))
    both = both.withColumn("name", name)
    head = F.concat(F.lit(BEGIN), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    both = both.withColumn("_head", head).withColumn("segment", F.concat("_head", _harmless(F.col("_text")), F.lit(END + "\n")))
    own = F.col("role") == "assistant"
    if "assistant" in context_roles:
        own = own & (F.col("_speaker") == F.col("perspective"))
    return both.select(
        F.col("_conv").alias(conv_col), "perspective", F.col("_turn").alias(turn_col), "role", "name", "segment",
        F.when(own, F.length("_head")).otherwise(0).cast("long").alias("mask_start"),
        F.when(own, F.length("segment") - 1).otherwise(0).cast("long").alias("mask_end"))
