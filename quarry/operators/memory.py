"""Conversation memory windows (per conversation, ordered by turn).

working_memory  - the newest ``last_n`` messages (default 20)
token_budget    - the newest messages whose running token total stays within
                  the budget (tokens = whitespace words x 1.3; default 52,000)
episodes        - messages evicted from the working window, oldest first, in
                  consecutive blocks of ``block`` (default 5); the newest
                  ``keep`` episodes (default 50) are kept
recall          - per conversation, the earlier messages most similar to the
                  newest user message: top-5 cosine, keep > 0.7, prefer recent,
                  return 3
export / erase  - one conversation's messages to JSON; delete by id list

The first three number all messages newest first (``ordering.numbered``), so a
message's recency and its place from the oldest are differences of numbers, and
an endless conversation is many tasks. The running token total has two levels:
sums per segment of ``SEGMENT`` messages, running sums of those joined back, and
running sums inside the segments that the budget reaches. ``recall`` is windowed by
conversation. Messages of the same turn are ordered by role and text; null turns
count as the oldest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import WORDS_PER_TOKEN
from ..functions.embed import hashed_embedding
from ..functions.text import words
from ..functions.vectors import dot
from .ordering import by_key, numbered


def _newest_first(conv: str, turn: str):
    return Window.partitionBy(conv).orderBy(F.col(turn).desc())


SEGMENT = 1024


def _placed(msgs: DataFrame, conv: str, turn: str) -> DataFrame:
    """Messages with ``_pos`` (0: the conversation's newest) and ``_size``."""
    ties = [F.col(c).desc() for c in ("role", "text") if c in msgs.columns]
    return by_key(numbered(msgs, F.col(conv), F.col(turn).desc(), *ties), conv)


def working_memory(msgs: DataFrame, last_n: int = 20, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    rows = _placed(msgs, conv, turn).where(F.col("_pos") < last_n)
    return rows.withColumn("recency", (F.col("_pos") + 1).cast("int")).drop("_n", "_pos", "_size")


def message_tokens(text) -> F.Column:
    return F.size(words(text)) * F.lit(WORDS_PER_TOKEN)


def token_budget(msgs: DataFrame, budget: float = 52000, conv: str = "conv_id", turn: str = "turn",
                 text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Words are summed as whole numbers and turned into tokens at the end."""
    rows = _placed(msgs, conv, turn).withColumn("_words", F.coalesce(F.size(words(text)), F.lit(0)).cast("long")) \
        .withColumn("_seg", F.floor(F.col("_pos") / segment))
    sums = rows.groupBy(F.col(conv).alias("_conv"), F.col("_seg").alias("_s")).agg(F.sum("_words").alias("_sum"))
    before = Window.partitionBy("_conv").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("_conv", "_s", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")) \
        .where(F.col("_before") * WORDS_PER_TOKEN <= budget)
    inside = Window.partitionBy(conv, "_seg").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = (rows.join(carry, F.col(conv).eqNullSafe(F.col("_conv")) & (F.col("_seg") == F.col("_s")))
               .withColumn("tokens", F.col("_words") * F.lit(WORDS_PER_TOKEN))
               .withColumn("running_tokens", (F.col("_before") + F.sum("_words").over(inside)) * F.lit(WORDS_PER_TOKEN))
               .where(F.col("running_tokens") <= budget))
    return out.drop("_n", "_pos", "_size", "_words", "_seg", "_conv", "_s", "_before")


def episodes(msgs: DataFrame, last_n: int = 20, block: int = 5, keep: int = 50, conv: str = "conv_id",
             turn: str = "turn", text: str = "text") -> DataFrame:
    """One row per kept episode: conv, episode, n_messages, first_turn, last_turn, text."""
    old = _placed(msgs, conv, turn).where(F.col("_pos") >= last_n)
    ep = (old.withColumn("_old", F.col("_size") - 1 - F.col("_pos"))                       # 0: the oldest message
             .withColumn("episode", F.floor(F.col("_old") / block))
             .withColumn("_last", F.floor((F.col("_size") - last_n - 1) / block))          # the newest episode
             .where(F.col("episode") > F.col("_last") - keep))
    # a group is one episode: ``block`` messages
    return ep.groupBy(conv, "episode").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_old", text))), lambda s: s[text]), "\n")
         .alias("text"))


def recall(msgs: DataFrame, top: int = 5, min_score: float = 0.7, keep: int = 3, conv: str = "conv_id",
           turn: str = "turn", role: str = "role", text: str = "text", embed=hashed_embedding) -> DataFrame:
    """Earlier messages recalled for each conversation's newest user message."""
    last_user = (msgs.where(F.col(role) == "user")
                     .withColumn("_r", F.row_number().over(_newest_first(conv, turn))).where("_r = 1")
                     .select(conv, F.col(turn).alias("q_turn"), F.col(text).alias("q_text")))
    qv = embed(last_user, "q_text", "q_vec")
    mv = embed(msgs.select(conv, turn, text), text, "m_vec")
    pairs = mv.join(qv, conv).where(F.col(turn) < F.col("q_turn")) \
              .withColumn("score", dot("q_vec", "m_vec"))
    best = pairs.withColumn("_s", F.row_number().over(
        Window.partitionBy(conv).orderBy(F.round("score", 9).desc(), F.col(turn).desc()))).where(F.col("_s") <= top)
    kept = best.where(F.col("score") > min_score)
    return (kept.withColumn("recall_rank", F.row_number().over(_newest_first(conv, turn)))
                .where(F.col("recall_rank") <= keep)
                .select(conv, "q_turn", turn, text, "score", "recall_rank"))


def export_history(msgs: DataFrame, conv_ids: DataFrame, path: str, conv: str = "conv_id") -> None:
    """Write the messages of the listed conversations as JSON lines."""
    msgs.join(conv_ids.select(conv).distinct(), conv, "left_semi").write.mode("overwrite").json(path)


def erase_history(msgs: DataFrame, conv_ids: DataFrame, conv: str = "conv_id") -> DataFrame:
    """New message snapshot without the listed conversations."""
    return msgs.join(conv_ids.select(conv).distinct(), conv, "left_anti")
