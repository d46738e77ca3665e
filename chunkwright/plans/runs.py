"""Sweeps of chunkers over datasets: plans, runs with time limits, resumption, regression cache."""

from __future__ import annotations

import itertools
import json
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.operators.chunkers import get_chunker

#: Spellings of booleans in configurations.
TRUE, FALSE = frozenset({"1", "true", "yes", "y", "on"}), frozenset({"0", "false", "no", "n", "off"})


def boolean(value, default: bool = False) -> bool:
    if value is None:
        return default
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    if word in TRUE | FALSE:
        return word in TRUE
    raise ValueError(f"no boolean: {value!r}")


def load_config(path: str) -> dict:
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def param_grid(grid: dict | None) -> list[dict]:
    """Every combination of the listed values; scalars stand for one."""
    if not grid:
        return [{}]
    values = [v if isinstance(v, list) else [v] for v in grid.values()]
    return [dict(zip(grid, combination, strict=True)) for combination in itertools.product(*values)]


def run_plan(config: dict) -> list[dict]:
    """Documents x chunkers x parameter combinations x repeats."""
    listed = lambda x: x if isinstance(x, list) else [x]
    out = []
    for docs, chunker, in itertools.product(listed(config["documents"]), listed(config["chunkers"])):
        chunker = {"name": chunker} if isinstance(chunker, str) else chunker
        for params, repeat in itertools.product(param_grid(chunker.get("param_grid")), range(int(config.get("repeats", 1)))):
            out.append({"documents": docs, "chunker": chunker["name"], "params": (chunker.get("params") or {}) | params, "repeat": repeat})
    return [{"run": f"run_{i:04d}", **p} for i, p in enumerate(out, 1)]


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def with_time_limit(spark: SparkSession, action: Callable, seconds: float | None):
    """Run a Spark action; its jobs are cancelled when the time is up."""
    if seconds is None:
        return action()
    tag = f"run-{uuid.uuid4().hex}"
    fired = threading.Event()

    def stop():
        fired.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if fired.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def run_sweep(spark: SparkSession, config: dict, read: Callable[[str], DataFrame], out: str, timeout: float | None = None, continue_on_error: bool = True, done: set | None = None) -> list[dict]:
    """Run a plan; passages go to out/<run>, metadata beside them.  ``done``: runs to skip."""
    cache: dict[str, DataFrame] = {}
    entries = []
    for plan in run_plan(config):
        if done and plan["run"] in done:
            continue
        started = time.monotonic()
        entry = {**plan, "started_at": _now()}
        try:
            docs = cache.setdefault(plan["documents"], read(plan["documents"]).persist())
            chunks = get_chunker(plan["chunker"], **plan["params"])(docs)
            with_time_limit(spark, lambda chunks=chunks, plan=plan: chunks.write.mode("overwrite").parquet(f"{out}/{plan['run']}"), timeout)
            entry |= {"status": "success", "passages": spark.read.parquet(f"{out}/{plan['run']}").count()}
        except Exception as e:
            entry |= {"status": "timeout" if isinstance(e, TimeoutError) else "failed", "error": str(e)[:2000]}
            if not continue_on_error:
                raise
        finally:
            entry["seconds"] = round(time.monotonic() - started, 3)
            entries.append(entry)
    for df in cache.values():
        df.unpersist()
    return entries


def resumed(plan: list[dict], before: list[dict]) -> set[str]:
    """Runs that succeeded before."""
    known = {p["run"] for p in plan}
    return {e["run"] for e in before if e["status"] == "success"} & known


def run_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    rows = [(e["run"], e["documents"], e["chunker"], json.dumps(e["params"], sort_keys=True, default=str), e["status"], e.get("passages"), e["seconds"], e.get("error")) for e in entries]
    return spark.createDataFrame(rows, "run string, documents string, chunker string, params string, status string, passages long, seconds double, error string")


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") != "success").alias("failed"))


def cached_baseline(signatures: DataFrame, timing: DataFrame) -> DataFrame:
    """Signatures of the runs whose timing row is finished, with their duration."""
    return signatures.join(timing.filter(F.col("status") == "finished").select("run", "duration_sec"), "run")
