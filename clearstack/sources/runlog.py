"""The record of a run: events, metrics and scenes, written as text in any store that Spark reaches."""

from __future__ import annotations

import dataclasses
import datetime as dt
import importlib.metadata
import platform
import time
from typing import Any

from pyspark.sql import SparkSession

from clearstack.config import Config
from clearstack.sources.files import write_bytes

LIBRARIES = ("pyspark", "pyarrow", "pandas", "numpy")


def versions() -> dict[str, str]:
    found = {"python": platform.python_version()}
    for name in LIBRARIES:
        try:
            found[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            found[name] = "not installed"
    return found


def environment(spark: SparkSession) -> dict[str, Any]:
    """What a run has to work with: versions, and the session's master, cores, memory and shared folder."""
    conf = spark.sparkContext.getConf()
    session = {"master": spark.sparkContext.master, "cores": spark.sparkContext.defaultParallelism, "shared folder": spark.conf.get("spark.checkpoint.dir", "not set")}
    memory = {k: conf.get(f"spark.{k}.memory", "default") for k in ("driver", "executor")}
    return versions() | session | {f"{k} memory": v for k, v in memory.items()}


class RunLog:
    def __init__(self, echo: bool = True) -> None:
        self.began, self.echo = time.time(), echo
        self.events: list[str] = []
        self.metrics: dict[str, Any] = {}
        self.scenes: list[dict[str, Any]] = []

    def say(self, text: str) -> None:
        self.events.append(f"[{dt.datetime.now():%Y-%m-%d %H:%M:%S}] {text}")
        if self.echo:
            print(self.events[-1])

    def scene(self, name: str, acquired: Any, cloud_cover: float | None, error: float | None) -> None:
        self.scenes.append({"id": name, "acquired": str(acquired), "cloud_cover": cloud_cover, "registration_error_px": error})

    def write(self, spark: SparkSession, path: str, config: Config) -> str:
        table = lambda d: [f"  {k}: {v}" for k, v in d.items()]
        parts = {
            "Run": table({"at": dt.datetime.now().isoformat(), "seconds": f"{time.time() - self.began:.2f}"}),
            "Configuration": table(dataclasses.asdict(config)),
            "Metrics": table(self.metrics),
            "Scenes": [f"  {s}" for s in self.scenes] or ["  none"],
            "Environment": table(environment(spark)),
            "Events": self.events,
        }
        text = "\n\n".join("\n".join([name, "-" * len(name), *lines]) for name, lines in parts.items())
        return write_bytes(spark, path, [(text + "\n").encode()])
