"""Pipelines as data: steps that can be named, stored, and run as one lazy plan; plugins by name."""

from __future__ import annotations

import json
import os
import shlex
import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import profile, relational
from millrace.options import Options
from millrace.plans.sql import run_sql
from millrace.sources.read import load
from millrace.sources.write import store


@dataclass(frozen=True)
class Plugin:
    name: str
    desc: str
    args: str
    run: Callable[..., DataFrame]


#: Known plugins by name.
PLUGINS: dict[str, Plugin] = {}


def plugin(name: str, desc: str = "", args: str = "") -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Makes a function a plugin: it gets a DataFrame (or, first in a pipeline, a SparkSession) and arguments."""

    def register(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        PLUGINS[name] = Plugin(name, desc, args, run)
        return run

    return register


def external(df: DataFrame, command: list[str]) -> DataFrame:
    """Rows as JSON lines through a program, one process a partition; its output lines come back as text.

    A program that ends with an error, or before it has read all lines, fails the task.
    """

    def run(batches):
        import threading

        import pyarrow as pa

        process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
        broken: list[BaseException] = []

        def feed() -> None:
            try:
                with process.stdin as out:
                    for batch in batches:
                        out.writelines(x + "\n" for x in batch.column(0).to_pylist())
            except BaseException as e:  # told to the reader
                broken.append(e)

        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        lines: list[str] = []
        for line in process.stdout:
            lines.append(line.rstrip("\n"))
            if len(lines) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                lines = []
        feeder.join()
        if process.wait() or broken:
            raise subprocess.CalledProcessError(process.returncode, command) from (broken[0] if broken else None)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string")


STEPS: dict[str, Callable[..., DataFrame]] = {
    "select": relational.select,
    "filter": relational.filter_rows,
    "sort": relational.sort,
    "limit": relational.limit,
    "top": relational.top_k,
    "group": relational.group,
    "pivot": relational.pivot,
    "unpivot": relational.unpivot,
    "describe": profile.describe,
    "nulls": profile.null_stats,
    "histogram": profile.histogram,
    "top_values": profile.top_values,
    "preview": profile.preview,
}


@dataclass
class Pipeline:
    """A list of steps, each a name with arguments. Building one runs nothing."""

    steps: list[dict] = field(default_factory=list)

    def then(self, step: str, **args) -> Pipeline:
        """This pipeline with one more step: load, join, union, sql, run (a plugin), store or one of STEPS."""
        if step not in STEPS and step not in ("load", "join", "union", "sql", "run", "store"):
            raise ValueError(f"{step!r} is no step")
        return Pipeline([*self.steps, {"step": step, **args}])

    def build(self, spark: SparkSession, df: DataFrame | None = None) -> DataFrame:
        """The frame of all steps; ``store`` steps write when they are reached."""
        for s in self.steps:
            args = {k: v for k, v in s.items() if k != "step"}
            if isinstance(args.get("options"), dict):
                args["options"] = Options(**args["options"])
            step = s["step"]
            if step == "load":
                df = load(spark, **args)
            elif step == "join":
                other = args.pop("with")
                df = relational.join(df, other if isinstance(other, DataFrame) else load(spark, other), **args)
            elif step == "union":
                df = relational.union([*([df] if df is not None else []), *(load(spark, p) for p in args["with"])])
            elif step == "sql":
                df = run_sql(spark, args["query"], df)
            elif step == "run":
                found = PLUGINS.get(args["name"])
                if found is None:
                    raise ValueError(f"no plugin {args['name']!r}; there are: {', '.join(PLUGINS) or 'none'}")
                df = found.run(df if df is not None else spark, *args.get("args", ()))
            elif step == "store":
                store(df, **args)
            else:
                df = STEPS[step](df, **args)
        if df is None:
            raise ValueError("the pipeline is empty")
        return df

    def to_json(self) -> str:
        return json.dumps(self.steps, indent=2)

    @staticmethod
    def from_json(text: str) -> Pipeline:
        out = Pipeline()
        for s in json.loads(text):
            out = out.then(**s)
        return out

    def save_as_plugin(self, name: str, folder: str, desc: str = "") -> str:
        """Stores the steps as a file that load_plugins finds."""
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{name}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"name": name, "desc": desc, "steps": self.steps}, f, indent=2)
        return path


def load_plugins(folder: str) -> list[str]:
    """Registers every stored pipeline of a folder; returns their names."""
    names = []
    for entry in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if entry.endswith(".json"):
            with open(os.path.join(folder, entry), encoding="utf-8") as f:
                spec = json.load(f)
            pipeline = Pipeline.from_json(json.dumps(spec["steps"]))

            def run(first, *_, p=pipeline) -> DataFrame:
                return p.build(first.sparkSession, first) if isinstance(first, DataFrame) else p.build(first)

            PLUGINS[spec["name"]] = Plugin(spec["name"], spec.get("desc", ""), "", run)
            names.append(spec["name"])
    return names


def log_run(path: str, command: list[str], pipeline: Pipeline) -> None:
    """Appends a command and its steps to the log, a JSON line each; a log that can't be written is no error."""
    try:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "command": shlex.join(command), "steps": pipeline.steps}) + "\n")
    except OSError:
        pass


def logged_runs(path: str, n: int = 20) -> list[dict]:
    """The last ``n`` entries of the log, latest first; lines that aren't whole are passed over."""
    if not os.path.exists(path):
        return []
    out = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            try:
                out.append(json.loads(line))
            except ValueError:
                continue
    return out[::-1][:n]


@plugin("inventory", "a small stock list", "")
def inventory(spark: SparkSession | DataFrame) -> DataFrame:
    session = spark if isinstance(spark, SparkSession) else spark.sparkSession
    rows = [("laptop", 15, 999.99), ("mouse", 120, 25.50), ("keyboard", 85, 75.00), ("monitor", 42, 350.00), ("headset", 60, 89.99)]
    return session.createDataFrame(rows, "item string, quantity int, price double")


@plugin("high-value", "sums per key above a limit", "KEY VALUE LIMIT")
def high_value(df: DataFrame, key: str, value: str, least: str) -> DataFrame:
    sums = relational.group(df, key, sum=value, count="1")
    return sums.where(F.col(f"`{value}_sum`") > float(least)).orderBy(F.desc(f"`{value}_sum`"))
