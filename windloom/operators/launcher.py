"""Experiment suites: configs merged, each run in its own task, failures as rows."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, Callable[[dict], dict]] = {}


def register(name: str, run: Callable[[dict], dict]) -> None:
    REGISTRY[name] = run


def deep_merge(base: dict, override: dict) -> dict:
    out = dict(base)
    for k, v in override.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def flatten(config: dict, sections: tuple[str, ...] = ()) -> dict:
    """Sections' keys at the top."""
    out = {}
    for k, v in config.items():
        if isinstance(v, dict) and (not sections or k in sections):
            out.update(flatten(v, sections))
        else:
            out[k] = v
    return out


def coerce(text: str, like):
    """A command-line value in the type of the default."""
    if isinstance(like, bool):
        return text.lower() in ("1", "true", "yes")
    return type(like)(text) if like is not None else text


def launch(spark: SparkSession, suite: dict, run: Callable[[dict], dict] | None = None) -> DataFrame:
    """run_id, name, result (JSON), error: a task for each run of {'defaults': .., 'runs': [..]}.

    Without ``run`` each run's config names a registered one under "run"; an unknown name is that run's error.
    """
    known = dict(REGISTRY)

    def named(config: dict) -> dict:
        if config.get("run") not in known:
            raise KeyError(f"unknown run {config.get('run')!r}")
        return known[config["run"]](config)

    run = run or named
    rows = [(i, str(r.get("name", i)), json.dumps(deep_merge(suite.get("defaults", {}), r))) for i, r in enumerate(suite["runs"])]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            try:
                out.append((r.run_id, r.name, json.dumps(run(json.loads(r.config)), sort_keys=True), None))
            except Exception as e:  # a failed run is a row of the suite
                out.append((r.run_id, r.name, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["run_id", "name", "result", "error"])

    return spark.createDataFrame(rows, "run_id int, name string, config string").groupBy("run_id").applyInPandas(one, "run_id int, name string, result string, error string")
