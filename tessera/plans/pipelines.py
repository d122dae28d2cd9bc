"""Declarative pipelines: extract, transform, load jobs with dependencies.

Each job is one lazy DataFrame chain that its sink turns into one Spark action; Spark runs and retries the tasks.
The driver only keeps the order of jobs.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

import yaml
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.records import transform
from tessera.sources.records import ConfigError, sink, source


@dataclass
class Job:
    id: str
    source: dict
    transforms: list[dict]
    sinks: list[dict]
    needs: list[str] = field(default_factory=list)
    retries: int = 0
    delay: float = 0.0
    factor: float | None = None
    max_delay: float = 60.0


@dataclass
class Result:
    status: str = "pending"
    read: int = 0
    written: int = 0
    attempts: int = 0
    error: str | None = None

    @property
    def dropped(self) -> int:
        return self.read - self.written


def load(text: str) -> list[Job]:
    """Jobs of a YAML document, checked: known types, known dependencies, no cycle; in an order that runs."""
    config = yaml.safe_load(text) or {}
    jobs = {}
    for raw in config.get("jobs", []):
        retry = raw.get("retry", {})
        jobs[raw["id"]] = Job(raw["id"], raw["source"], raw.get("transforms", []), raw.get("sinks", []), raw.get("needs", []), retry.get("count", 0), retry.get("delay", 0), retry.get("factor"), retry.get("max_delay", 60))
    for job in jobs.values():
        source(job.source["type"])
        for t in job.transforms:
            transform(t["type"])
        for s in job.sinks:
            sink(s["type"])
        if unknown := set(job.needs) - set(jobs):
            raise ConfigError(f"{job.id} needs unknown jobs {sorted(unknown)}")
    try:
        return [jobs[k] for k in TopologicalSorter({j.id: j.needs for j in jobs.values()}).static_order()]
    except CycleError as e:
        raise ConfigError(f"jobs depend on each other: {e.args[1]}") from e


def frame(spark: SparkSession, job: Job) -> DataFrame:
    """The job's chain, not run: transforms apply in the order given."""
    df = source(job.source["type"])(spark, job.source.get("options", {}))
    for t in job.transforms:
        df = transform(t["type"])(df, t.get("options", {}))
    return df


def run_job(spark: SparkSession, job: Job) -> Result:
    result = Result()
    for attempt in range(job.retries + 1):
        result.attempts += 1
        try:
            seen, kept = Observation(), Observation()
            df = source(job.source["type"])(spark, job.source.get("options", {})).observe(seen, F.count(F.lit(1)).alias("n"))
            for t in job.transforms:
                df = transform(t["type"])(df, t.get("options", {}))
            df = df.observe(kept, F.count(F.lit(1)).alias("n"))
            lazy = [s for s in job.sinks if s["type"] == "memory"]
            for s in job.sinks:
                sink(s["type"])(df, s.get("options", {}))
            if len(lazy) < len(job.sinks):  # a frame kept in memory runs nothing, so nothing is counted
                result.read, result.written = seen.get["n"], kept.get["n"]
            result.status, result.error = "success", None
            return result
        except ConfigError:
            raise
        except Exception as e:  # noqa: BLE001  any failure of the Spark job counts as the job's
            result.status, result.error = "failed", str(e)
            if attempt < job.retries:
                time.sleep(min(job.max_delay, job.delay * job.factor ** (attempt + 1)) if job.factor else job.delay)
    return result


def run(spark: SparkSession, jobs: list[Job]) -> dict[str, Result]:
    """Run all jobs; those that need a job without success are skipped, other branches go on."""
    results: dict[str, Result] = {}
    for job in jobs:
        if any(results[n].status != "success" for n in job.needs):
            results[job.id] = Result("skipped")
        else:
            results[job.id] = run_job(spark, job)
    return results
