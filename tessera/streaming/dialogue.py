"""Dialogues as a stream: each conversation's turns are state, kept by key and spilled by the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv_id long, turn long, question string, answer string, n_before int"


def _pairs(turns: pd.DataFrame, pending: list) -> tuple[list, list]:
    """(turn, question, answer) of user turns that the next assistant turn answers, and the question left open."""
    done = []
    for r in turns.sort_values("turn").itertuples():
        if r.role == "user":
            pending = [int(r.turn), r.text]
        elif r.role == "assistant" and pending:
            done.append((pending[0], pending[1], r.text))
            pending = []
    return done, pending


def dialogue_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer, n_before) for a stream (or table) of (conv_id, turn, role, text).

    n_before counts the earlier pairs of the conversation.  Rows of a batch come
    in any order and are sorted by turn; a question may wait for its answer in a later batch.
    """
    if not turns.isStreaming:
        said = turns.where(F.col("role").isin("user", "assistant"))
        by = W.partitionBy("conv_id").orderBy("turn")
        said = said.select("*", F.lead("role").over(by).alias("_role"), F.lead("text").over(by).alias("answer"))
        pairs = said.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")
        return pairs.withColumn("n_before", F.row_number().over(by) - 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, turn, text = state.get if state.exists else (0, -1, "")
        done, pending = _pairs(pd.concat(list(batches)), [turn, text] if turn >= 0 else [])
        yield pd.DataFrame([(key[0], t, q, a, n + i) for i, (t, q, a) in enumerate(done)], columns=["conv_id", "turn", "question", "answer", "n_before"])
        state.update((n + len(done), *(pending or [-1, ""])))

    return turns.groupBy("conv_id").applyInPandasWithState(step, OUT, "n int, turn long, text string", "append", GroupStateTimeout.NoTimeout)


def run_available(pairs: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet files below a folder that all executors share, and reads them."""
    query = pairs.writeStream.format("parquet").option("path", f"{folder}/pairs").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return pairs.sparkSession.read.schema(pairs.schema).parquet(f"{folder}/pairs")


def last_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """(conv_id, n_pairs, history): the number of a conversation's pairs, and the last n (q, a) in order; no more than n are collected."""
    late = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = F.when(F.col("_k") <= n, F.struct("turn", F.col("question").alias("q"), F.col("answer").alias("a")))
    x = pairs.withColumn("_k", F.row_number().over(late)).groupBy("conv_id").agg(F.count("*").alias("n_pairs"), F.array_sort(F.collect_list(kept)).alias("_h"))
    return x.select("conv_id", "n_pairs", F.transform("_h", lambda h: F.struct(h["q"].alias("q"), h["a"].alias("a"))).alias("history"))


def histories(pairs: DataFrame) -> DataFrame:
    """(conv_id, history): all pairs (q, a) of each conversation in order."""
    return pairs.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))), lambda x: F.struct(x["question"].alias("q"), x["answer"].alias("a"))).alias("history"))
