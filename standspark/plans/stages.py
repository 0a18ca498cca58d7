"""Stages, their dependencies, cache keys and a run: named steps from tables to tables."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import platform
import subprocess
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, without_defaults


class StageError(ValueError):
    """A stage broke its contract."""


class Context:
    """Tables by name; each is written once."""

    def __init__(self, initial: Mapping[str, DataFrame] | None = None):
        self._tables = dict(initial or {})

    def put(self, name: str, table: DataFrame) -> None:
        if name in self._tables:
            raise StageError(f"{name} has been made already")
        self._tables[name] = table

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise StageError(f"{name} hasn't been made")
        return self._tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self._tables


@dataclass(frozen=True)
class Stage:
    """A step: what it needs, what it makes, which blocks of the configuration it depends on."""

    name: str
    run: Callable[[SparkSession, Context, Config], dict[str, DataFrame]]
    needs: tuple[str, ...] = ()
    makes: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ()
    revision: int = 1


class Registry:
    def __init__(self):
        self._stages: dict[str, Stage] = {}

    def add(self, stage: Stage) -> Stage:
        if stage.name in self._stages:
            raise StageError(f"two stages named {stage.name}")
        if made := [m for s in self._stages.values() for m in s.makes if m in stage.makes]:
            raise StageError(f"{made[0]} is made by another stage")
        self._stages[stage.name] = stage
        return stage

    def __getitem__(self, name: str) -> Stage:
        if name not in self._stages:
            raise StageError(f"no stage named {name}; there are {', '.join(sorted(self._stages))}")
        return self._stages[name]

    def closure(self, wanted: Iterable[str], given: Iterable[str] = ()) -> list[Stage]:
        """Stages that lead to the wanted tables, in order: only what some consumer reads."""
        maker = {m: s for s in self._stages.values() for m in s.makes}
        order: list[Stage] = []
        given, open_ = set(given), []

        def visit(table: str) -> None:
            if table in given:
                return
            if table not in maker:
                raise StageError(f"nothing makes {table}")
            stage = maker[table]
            if stage in order:
                return
            if stage.name in open_:
                raise StageError(f"{stage.name} needs its own result")
            open_.append(stage.name)
            for need in stage.needs:
                visit(need)
            open_.pop()
            order.append(stage)

        for table in wanted:
            visit(table)
        return order


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def fingerprint(config: Config) -> str:
    """Ten hex digits of what the configuration sets besides its defaults."""
    return hashlib.sha256(canonical(without_defaults(config)).encode()).hexdigest()[:10]


def step_keys(order: list[Stage], config: Config, inputs: Mapping[str, str] | None = None) -> dict[str, str]:
    """A key per stage from its blocks, its revision, the inputs and the keys of all stages before it."""
    maker = {m: s.name for s in order for m in s.makes}
    keys: dict[str, str] = {}
    for s in order:
        own = {b: without_defaults(v) if (v := getattr(config, b)) is not None else None for b in s.blocks}
        before = {n: keys[maker[n]] if n in maker else (inputs or {}).get(n, "") for n in s.needs}
        keys[s.name] = hashlib.sha256(canonical([s.name, s.revision, own, before]).encode()).hexdigest()[:10]
    return keys


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table stands at a path, on whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@dataclass
class Record:
    stage: str
    key: str
    seconds: float
    cached: list[str] = field(default_factory=list)


#: Places of kept tables: all in one folder, or a folder for each stage.
LAYOUTS = {"flat": "{cache}/{table}__s{key}", "by_stage": "{cache}/{stage}/{table}__s{key}"}


def place_of(cache: str, stage: str, table: str, key: str, layout: str = "flat") -> str:
    if layout not in LAYOUTS:
        raise StageError(f"a layout is one of {', '.join(LAYOUTS)}, not {layout!r}")
    return LAYOUTS[layout].format(cache=cache.rstrip("/"), stage=stage, table=table, key=key)


def run_log(folder: str, run: str) -> logging.Logger:
    """A logger of its own for a run, which writes to run.log in the run's folder on the driver."""
    place = os.path.join(folder, run)
    os.makedirs(place, exist_ok=True)
    log = logging.getLogger(f"standspark.{run}")
    if not log.handlers:
        handler = logging.FileHandler(os.path.join(place, "run.log"), encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


def run(spark: SparkSession, registry: Registry, wanted: Iterable[str], config: Config, initial: Mapping[str, DataFrame] | None = None, cache: str | None = None, inputs: Mapping[str, str] | None = None, layout: str = "flat") -> tuple[Context, dict]:
    """Run the stages that the wanted tables need; (context, manifest).

    With a cache folder each table is kept under its stage's key.  A stage all of whose tables are
    there is not run; one that lacks some runs, and those that are there are read.
    """
    context = Context(initial)
    order = registry.closure(wanted, initial or {})
    keys, records = step_keys(order, config, inputs), []
    for s in order:
        began = time.time()
        place = {m: place_of(cache, s.name, m, keys[s.name], layout) for m in s.makes} if cache else {}
        hit = [m for m, p in place.items() if exists(spark, p)]
        made = {} if len(hit) == len(s.makes) and hit else s.run(spark, context, config)
        if made and set(made) != set(s.makes):
            raise StageError(f"{s.name} made {sorted(made)} instead of {sorted(s.makes)}")
        for m in s.makes:
            if m in hit:
                table = spark.read.parquet(place[m])
            else:
                table = made[m]
                if cache:
                    table.write.mode("overwrite").parquet(place[m])
                    table = spark.read.parquet(place[m])
            context.put(m, table)
        records.append(Record(s.name, keys[s.name], time.time() - began, hit))
    return context, manifest(config, records)


def manifest(config: Config, records: list[Record]) -> dict:
    return {"run": uuid.uuid4().hex, "fingerprint": fingerprint(config), "stages": [vars(r) for r in records], "provenance": provenance()}


def provenance() -> dict:
    """Versions and the state of the working tree, code that isn't tracked included."""
    import pyspark

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", *args], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    status = git("status", "--porcelain")
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "commit": git("rev-parse", "HEAD"), "dirty": None if status is None else bool([x for x in status.splitlines() if not x.startswith("??") or x.endswith(".py")])}


def cost_by_stage(log: DataFrame, task: str, ts: str, cost: str, stages: DataFrame, stage: str, start: str) -> DataFrame:
    """Cost of logged tasks by the stage during which each began.

    stages: (stage, start).  Each stage lasts until the next begins; a task before the first has none.
    """
    from pyspark.sql import Window

    spans = stages.withColumn("_end", F.lead(start).over(Window.orderBy(start)))  # one row per stage of a run
    met = log.join(spans, (F.col(ts) >= F.col(start)) & (F.col("_end").isNull() | (F.col(ts) < F.col("_end"))), "left")
    return met.groupBy(stage).agg(F.count(task).alias("n_tasks"), F.sum(cost).alias("cost"))
