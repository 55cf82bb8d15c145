"""Metrics of the audit trail: totals, latencies, paths, recency, and the response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.constants import ACCURACY, CACHE_CAP, CACHE_TTL_S, NODES


def once(trace: DataFrame) -> DataFrame:
    """Each step once however often it was sent. Where the run is there too, rows are placed by it, so that what is asked of
    a run next needs no second exchange; a run has a few dozen steps."""
    if "run_id" in trace.columns:
        return trace.repartition("run_id").dropDuplicates(["run_id", "trace_id"])
    return trace.dropDuplicates(["trace_id"])


def totals(trace: DataFrame) -> DataFrame:
    """Per run: steps, latency, tokens, errors, distinct agents and mean latency a step."""
    return trace.groupBy("run_id").agg(
        F.count("*").alias("steps"), F.sum("latency_ms").alias("latency_ms"), F.sum("tokens_input").alias("tokens_in"), F.sum("tokens_output").alias("tokens_out"),
        F.count_if("error_occurred").alias("errors"), F.countDistinct("agent_name").alias("agents"), F.avg("latency_ms").alias("mean_latency_ms"),
    )


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """keys, out: the exact percentile (linear between neighbours, like quantile_cont) of non-negative values, nulls left out.

    Equal values are counted together first; a histogram on a logarithmic scale (a few thousand buckets a key at most)
    tells the buckets that hold the two neighbours, and only their values are put in order. No key's values are
    gathered or sorted whole. Null keys are a key of their own.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.log2(F.col("_v") + 1) * 256))
    per_key = W.partitionBy(*keys)
    hist = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_h"))
    hist = hist.withColumns({"_below": F.sum("_h").over(per_key.orderBy("_b")) - F.col("_h"), "_pos": (F.sum("_h").over(per_key) - 1) * p})
    lo, hi = F.floor("_pos"), F.ceil("_pos")
    wanted = hist.where(((F.col("_below") <= lo) & (lo < F.col("_below") + F.col("_h"))) | ((F.col("_below") <= hi) & (hi < F.col("_below") + F.col("_h"))))
    wanted = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_wb"), "_below", "_pos")
    same = [counts[k].eqNullSafe(wanted[f"_k{i}"]) for i, k in enumerate(keys)]
    near = counts.join(wanted, [*same, F.col("_b") == F.col("_wb")])
    upto = F.col("_below") + F.sum("_n").over(W.partitionBy(*keys, "_b").orderBy("_v"))
    near = near.withColumn("_upto", upto)
    holds = lambda rank: (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
    ends = near.groupBy(*keys).agg(F.max(F.when(holds(lo), F.col("_v"))).alias("_lo"), F.max(F.when(holds(hi), F.col("_v"))).alias("_hi"), F.max("_pos").alias("_pos"))
    return ends.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - lo)).alias(out))


def path(trace: DataFrame) -> DataFrame:
    """Per run: the agents in the order of their steps, repeats in a row collapsed, as "a > b > c", and the distinct ones."""
    w = W.partitionBy("run_id").orderBy("step", "trace_id")
    rows = trace.select("run_id", "step", "trace_id", "agent_name").withColumn("_before", F.lag("agent_name").over(w))
    kept = rows.where(F.col("_before").isNull() | (F.col("_before") != F.col("agent_name")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("step", "trace_id", "agent_name"))), lambda x: x["agent_name"])
    return kept.groupBy("run_id").agg(F.array_join(ordered, " > ").alias("path"), F.array_join(F.array_distinct(ordered), " > ").alias("nodes"))


def edges(trace: DataFrame) -> DataFrame:
    """from_agent, to_agent, n: how often one agent's step follows another's in a run."""
    w = W.partitionBy("run_id").orderBy("step", "trace_id")
    return trace.select(F.col("agent_name").alias("from_agent"), F.lead("agent_name").over(w).alias("to_agent")).where("to_agent is not null").groupBy("from_agent", "to_agent").agg(F.count("*").alias("n"))


def mermaid(counted: DataFrame) -> DataFrame:
    """One row, diagram: the counted edges as a Mermaid flow chart, in the order of their agents' names.

    There are as many edges as pairs of agents, a fixed small number.
    """
    line = F.concat(F.lit("  "), "from_agent", F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), "to_agent")
    ordered = F.array_sort(F.collect_list(line))
    return counted.agg(F.concat(F.lit("flowchart TD\n"), F.array_join(ordered, "\n")).alias("diagram"))


def node(agent: Column) -> Column:
    """The node of an agent in diagrams; of agents without one their name in lower case, "unknown" for null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in NODES.items() for x in p]), agent), F.lower(agent), F.lit("unknown"))


def diagrams(trace: DataFrame) -> DataFrame:
    """run_id, flow, sequence: the run's nodes in the order of its steps, repeats in a row collapsed, as a Mermaid flow
    chart and as a sequence diagram. A run has a few dozen steps, which fit one row."""
    w = W.partitionBy("run_id").orderBy("step", "trace_id")
    named = trace.select("run_id", "step", "trace_id", node(F.col("agent_name")).alias("node"))
    kept = named.withColumn("_before", F.lag("node").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("node")))
    path = kept.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "trace_id", "node"))), lambda x: x["node"]).alias("p"))
    p = F.col("p")
    pairs = F.arrays_zip(F.concat(F.array(F.lit("START")), p).alias("a"), F.concat(p, F.array(F.lit("END"))).alias("b"))

    def edge(x: Column) -> Column:
        arrow = F.when((x["a"] == "validate") & (x["b"] == "repair"), " -.->|needs repair| ").when((x["a"] == "repair") & (x["b"] == "validate"), " -.->|retry| ").otherwise(" --> ")
        return F.concat(F.lit("    "), x["a"], arrow, x["b"])

    flow = F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform(pairs, edge), "\n"))
    steps = F.arrays_zip(F.concat(F.array(F.lit("Workflow")), p).alias("a"), p.alias("b"))
    calls = F.transform(F.filter(steps, lambda x: x["b"].isNotNull()), lambda x: F.concat(F.lit("    "), x["a"], F.lit("->>+"), x["b"], F.lit(": run\n    "), x["b"], F.lit("-->>-"), x["a"], F.lit(": done")))
    members = F.transform(F.array_distinct(p), lambda x: F.concat(F.lit("    participant "), x))
    sequence = F.concat_ws("\n", F.lit("sequenceDiagram"), F.array_join(members, "\n"), F.array_join(calls, "\n"))
    return path.select("run_id", flow.alias("flow"), sequence.alias("sequence"))


def numbered(trace: DataFrame) -> DataFrame:
    """run_id, trace_id, no: the steps of a run numbered from 1."""
    return trace.select("run_id", "trace_id", F.row_number().over(W.partitionBy("run_id").orderBy("step", "trace_id")).alias("no"))


def last_of(trace: DataFrame, agent: str) -> DataFrame:
    """Per run: the last step of an agent, by max_by in one aggregation."""
    at = F.struct("step", "trace_id")
    return trace.where(F.col("agent_name") == agent).groupBy("run_id").agg(F.max_by("trace_id", at).alias("trace_id"), F.max("step").alias("step"))


def preview(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def batch_summary(runs: DataFrame) -> DataFrame:
    """runs, successes, success_rate, mean accuracy and mean recall over successes (0 if none), and how many meet the
    threshold. runs: success, current_accuracy and, for the recall, recall."""
    ok = F.coalesce("success", F.lit(False))
    return runs.agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.coalesce(F.count_if(ok) / F.count("*"), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("current_accuracy"))), F.lit(0.0)).alias("mean_accuracy"),
        *([F.coalesce(F.avg(F.when(ok, F.col("recall"))), F.lit(0.0)).alias("mean_recall")] if "recall" in runs.columns else []), F.count_if(F.col("current_accuracy") >= ACCURACY).alias("meeting_threshold"),
    )


def retry_after_s(message: Column) -> Column:
    """Seconds of a hint such as "try again in 1m2.5s", "7s" or "250ms"; null without one."""
    hint = r"(?i)(?:try again in|retry after)\s*(?:([0-9]+)m(?!s))?(?:([0-9.]+)(ms|s))?"
    m, n, unit = (F.regexp_extract(message, hint, i) for i in (1, 2, 3))
    number = n.try_cast("double")
    seconds = F.when(unit == "ms", number / 1000).when(unit == "s", number)
    return F.when((m != "") | seconds.isNotNull(), F.coalesce(m.try_cast("double"), F.lit(0.0)) * 60 + F.coalesce(seconds, F.lit(0.0)))


def is_rate_limit(message: Column) -> Column:
    return F.lower(message).rlike("429|rate limit|too many requests|ratelimit")


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON, nulls kept apart from empty texts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts])), 256)


def request_key(prompt: Column, system_prompt: Column, max_tokens: Column, temperature: Column, provider: Column, model: Column) -> Column:
    """SHA-256 of the six inputs of a model request as one JSON object with its names in order; nulls are JSON nulls."""
    inputs = {"force_provider": provider, "max_tokens": max_tokens, "model": model, "prompt": prompt, "system_prompt": system_prompt, "temperature": temperature}
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in inputs.items()]), {"ignoreNullFields": "false"}), 256)


def live_cache(entries: DataFrame, now: Column, ttl_s: int = CACHE_TTL_S, cap: int = CACHE_CAP) -> DataFrame:
    """Entries (cache_key, created_at, last_accessed) within their time, the most recently used up to the cap.

    The cap is a top-k: a global order by last access with the key as tie-break, taken by TakeOrdered.
    """
    fresh = entries.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= ttl_s)
    return fresh.orderBy(F.desc("last_accessed"), F.desc("cache_key")).limit(cap)
