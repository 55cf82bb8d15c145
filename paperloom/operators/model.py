"""Model calls behind one seam: requests are deduplicated by cache key and answered by a provider.

The default provider replays recorded answers. A request without a recorded answer keeps a null answer and an error;
no answer is ever made up.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.fields import unfenced
from paperloom.operators.trace import cache_key


class Provider(Protocol):
    """Answers for requests: cache_key and prompt in; cache_key, content, tokens_in, tokens_out out."""

    def answer(self, requests: DataFrame) -> DataFrame: ...


class Recorded:
    """Replays a table of cache_key, content, tokens_in, tokens_out; the newest entry of a key by created_at."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def answer(self, requests: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct("content", "tokens_in", "tokens_out"), F.struct("created_at", "content")).alias("r")
        return requests.join(self.responses.groupBy("cache_key").agg(newest), "cache_key").select("cache_key", "r.*")


def request_key(provider: Column, model: Column, system: Column, prompt: Column, max_tokens: Column, temperature: Column) -> Column:
    return cache_key(provider, model, system, prompt, max_tokens, temperature)


def ask(df: DataFrame, key: Column, prompt: Column, *providers: Provider) -> DataFrame:
    """`df` with answer, answer_json (unfenced), tokens_in, tokens_out and answer_error.

    Distinct requests go to the providers in order; each next one sees only what is still open.
    """
    asked = df.withColumn("_key", key)
    open_ = asked.select(F.col("_key").alias("cache_key"), prompt.alias("prompt")).dropDuplicates(["cache_key"])
    answered = None
    for provider in providers:
        got = provider.answer(open_).select("cache_key", "content", "tokens_in", "tokens_out")
        answered = got if answered is None else answered.unionByName(got)
        open_ = open_.join(got.select("cache_key"), "cache_key", "left_anti")
    out = asked.join(answered.withColumnRenamed("cache_key", "_key"), "_key", "left").drop("_key").withColumnRenamed("content", "answer")
    missing = F.when(F.col("answer").isNull(), "no recorded answer")
    return out.withColumns({"answer_json": unfenced(F.col("answer")), "answer_error": missing})
