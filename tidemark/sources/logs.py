"""Nested simulation logs and JSON-lines run traces as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running


def flatten_agents(logs: DataFrame, states: str = "states") -> DataFrame:
    """array<map<agent, struct>> per episode into one row per (episode, step, agent)."""
    steps = logs.select("episode", F.posexplode(states).alias("step", "_agents"))
    return steps.select("episode", "step", F.explode("_agents").alias("agent", "_state")).select("episode", "step", "agent", "_state.*")


def flatten_world(logs: DataFrame, world: str = "world") -> DataFrame:
    """One row per (episode, step); fields that only year-end steps carry are NULL elsewhere."""
    return logs.select("episode", F.posexplode(world).alias("step", "_w")).select("episode", "step", "_w.*")


def flatten_values(logs: DataFrame, field: str, name: str) -> DataFrame:
    """array<map<agent, value>> per episode (actions, rewards) into one row per (episode, step, agent)."""
    steps = logs.select("episode", F.posexplode(field).alias("step", "_v"))
    return steps.select("episode", "step", F.explode("_v").alias("agent", name))


def replay(trace: DataFrame, run: str, step: str, phase: str, acting: str = "act") -> tuple[DataFrame, DataFrame]:
    """(steps with the count of tool calls so far, one summary row per run).

    The running count is summed in two levels, so one run that holds much of the trace is
    not sorted in a single task.
    """
    marked = trace.select(run, step, phase, (F.col(phase) == acting).cast("long").alias("_call"))
    steps = running(marked, [run], step, ["_call"]).select(run, step, phase, (F.col("before__call") + F.col("_call")).alias("tool_calls_so_far"))
    summary = trace.groupBy(run).agg(
        F.count("*").alias("n_steps"), F.count_if(F.col(phase) == acting).alias("tool_call_count"),
        F.min_by(phase, step).alias("first_phase"), F.max_by(phase, step).alias("last_phase"))
    return steps, summary
