"""Staged runs that can be resumed: each stage's result is a table, its state a small JSON file."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quarrymill.session import read_text, write_text

Stage = Callable[[DataFrame | None, Mapping[str, Any], SparkSession], DataFrame]
PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"


@dataclass
class StageState:
    name: str
    status: str = PENDING
    output: str | None = None
    rows: int | None = None
    seconds: float | None = None
    error: str | None = None


@dataclass
class PipelineState:
    name: str
    created: float
    stages: list[StageState] = field(default_factory=list)

    @property
    def status(self) -> str:
        kinds = {s.status for s in self.stages}
        return FAILED if FAILED in kinds else COMPLETED if kinds <= {COMPLETED} else RUNNING if COMPLETED in kinds or RUNNING in kinds else PENDING


class Pipeline:
    """An ordered list of named stages. ``run`` skips what is completed, so a stopped run goes on where it was."""

    def __init__(self, spark: SparkSession, name: str, folder: str, stages: Sequence[tuple[str, Stage]], config: Mapping[str, Any] | None = None) -> None:
        self.spark, self.folder, self.stages, self.config = spark, folder, list(stages), config or {}
        self.state_path = f"{folder}/{name}.json"
        self.state = self._load() or PipelineState(name, time.time(), [StageState(n) for n, _ in self.stages])

    def _load(self) -> PipelineState | None:
        text = read_text(self.spark, self.state_path)
        if text is None:
            return None
        raw = json.loads(text)
        return PipelineState(raw["name"], raw["created"], [StageState(**s) for s in raw["stages"]])

    def _save(self) -> None:
        write_text(self.spark, self.state_path, json.dumps(asdict(self.state), ensure_ascii=False, indent=1))

    def run(self, start: str | None = None, stop: str | None = None, notify: Callable[[str, str], None] | None = None) -> PipelineState:
        """Runs from ``start`` to ``stop`` inclusive. A failing stage is recorded and its error raised.

        With ``start``, that stage and all after it lose their results, since they rest on it.
        """
        names = [n for n, _ in self.stages]
        first, last = names.index(start) if start else 0, names.index(stop) if stop else len(names) - 1
        current: DataFrame | None = None
        for i, (name, stage) in enumerate(self.stages):
            state = self.state.stages[i]
            if start and i >= first:
                self.state.stages[i] = state = StageState(name)
            if state.status == COMPLETED:
                current = self.spark.read.parquet(state.output) if state.output else None
                continue
            if i < first or i > last:
                continue
            began = time.time()
            state.status, state.error = RUNNING, None
            self._save()
            try:
                output = f"{self.folder}/{i:02d}_{name}.parquet"
                stage(current, self.config, self.spark).write.mode("overwrite").parquet(output)
                current = self.spark.read.parquet(output)
                state.rows, state.output, state.status = current.count(), output, COMPLETED
            except Exception as error:
                state.status, state.error = FAILED, str(error)[:500]
                raise
            finally:
                state.seconds = round(time.time() - began, 3)
                self._save()
                if notify:
                    notify(name, state.status)
        return self.state


def list_pipelines(spark: SparkSession, folder: str, limit: int = 20) -> list[dict[str, Any]]:
    """The most recent pipelines of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(f.getPath()) for f in fs.listStatus(p)] if fs.exists(p) else []
    found = [json.loads(read_text(spark, f) or "{}") for f in names if f.endswith(".json")]
    return sorted(found, key=lambda x: -x["created"])[:limit]


def resolve_domain(config: Mapping[str, Any], name: str) -> Mapping[str, Any]:
    """The definition of a domain, whether it stands at the top level or below ``domains``."""
    return config.get(name) or (config.get("domains") or {}).get(name) or {}


def domain_attributes(domain: Mapping[str, Any]) -> list[str]:
    return [a["name"] for a in (domain.get("schema") or {}).get("attributes", []) if a.get("name")]
