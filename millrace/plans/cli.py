"""Command line: steps joined with ``then`` run as one plan in one process.

    python -m millrace.plans.cli load sales.csv then filter "amount > 100" then group region --sum amount then store out.csv
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from millrace.operators.profile import render
from millrace.plans.pipeline import PLUGINS, Pipeline, load_plugins, log_run, logged_runs
from millrace.session import local_session
from millrace.sources.read import preview_schema, read_lines
from millrace.sources.write import print_arrow, print_csv


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="step", required=True)
    p = sub.add_parser("load", help="read files, a pattern, a directory or a URL")
    p.add_argument("source", nargs="?")
    p.add_argument("--max-files", type=int)
    p.add_argument("--parallel", type=int, help="accepted; Spark decides")
    p.add_argument("--format")
    p.add_argument("--schema-preview", action="store_true")
    p = sub.add_parser("select", help="keep columns")
    p.add_argument("columns", nargs="+")
    p = sub.add_parser("filter", help="keep rows")
    p.add_argument("text")
    p = sub.add_parser("sort", help="order rows")
    p.add_argument("keys", nargs="+")
    p = sub.add_parser("group", help="aggregate")
    p.add_argument("keys", nargs="?", default="")
    for f in ("sum", "avg", "min", "max", "count"):
        p.add_argument(f"--{f}", action="append", default=[])
    p = sub.add_parser("join", help="join with files")
    p.add_argument("sources", nargs="+")
    p.add_argument("--on", required=True)
    p.add_argument("--type", default="inner")
    p = sub.add_parser("union", help="append files by column name")
    p.add_argument("sources", nargs="+")
    p = sub.add_parser("pivot", help="rows to columns")
    for f in ("index", "column", "values"):
        p.add_argument(f"--{f}", required=True)
    p = sub.add_parser("unpivot", help="columns to rows")
    p.add_argument("--id", default="")
    p.add_argument("--values", required=True)
    p.add_argument("--name", default="variable")
    p.add_argument("--value", default="value")
    for name, helps in (("describe", "columns and types"), ("nulls", "null counts")):
        sub.add_parser(name, help=helps)
    p = sub.add_parser("histogram", help="bins of a numeric column")
    p.add_argument("column")
    p.add_argument("--bins", type=int, default=20)
    p = sub.add_parser("top_values", help="frequent values")
    p.add_argument("column")
    p.add_argument("-k", type=int, default=20)
    p = sub.add_parser("head", help="first rows")
    p.add_argument("-n", type=int, default=10)
    p = sub.add_parser("sql", help="query the table stdin")
    p.add_argument("query")
    p.add_argument("--file", action="store_true", help="accepted; tables are read in place")
    p.add_argument("--arrow", action="store_true", help="accepted; tables are read in place")
    p = sub.add_parser("run", help="run a plugin")
    p.add_argument("name")
    p.add_argument("args", nargs="*")
    p = sub.add_parser("store", help="write a file (none: CSV on standard output)")
    p.add_argument("path", nargs="?")
    p = sub.add_parser("save", help="keep the steps before, or those of the last run, as a plugin instead of running them")
    p.add_argument("name")
    p.add_argument("--last", action="store_true")
    p.add_argument("--desc", default="")
    p = sub.add_parser("view", help="show the first rows as a grid")
    p.add_argument("-n", type=int, default=20)
    sub.add_parser("plugins", help="list plugins")
    p = sub.add_parser("history", help="list the last runs, latest first")
    p.add_argument("-n", type=int, default=20)
    return top


def parse(argv: list[str]) -> list[argparse.Namespace]:
    """One namespace a step."""
    steps: list[list[str]] = [[]]
    for a in argv:
        if a == "then":
            steps.append([])
        else:
            steps[-1].append(a)
    parser = _parser()
    return [parser.parse_args(s) for s in steps]


def pipeline_of(steps: list[argparse.Namespace]) -> Pipeline:
    out = Pipeline()
    for a in steps:
        if a.step == "load" and a.source:
            out = out.then("load", source=a.source, fmt=a.format, max_files=a.max_files)
        elif a.step == "select":
            out = out.then("select", columns=",".join(a.columns))
        elif a.step == "filter":
            out = out.then("filter", text=a.text)
        elif a.step == "sort":
            out = out.then("sort", keys=",".join(a.keys))
        elif a.step == "group":
            out = out.then("group", keys=a.keys, **{f: ",".join(getattr(a, f)) for f in ("sum", "avg", "min", "max", "count")})
        elif a.step == "join":
            if len(a.sources) > 1:
                out = out.then("load", source=a.sources[0])
            out = out.then("join", **{"with": a.sources[-1], "on": a.on, "how": a.type})
        elif a.step == "union":
            out = out.then("union", **{"with": a.sources})
        elif a.step == "pivot":
            out = out.then("pivot", index=a.index, column=a.column, values=a.values)
        elif a.step == "unpivot":
            out = out.then("unpivot", ids=a.id, values=a.values, name=a.name, value=a.value)
        elif a.step == "histogram":
            out = out.then("histogram", column=a.column, bins=a.bins)
        elif a.step == "top_values":
            out = out.then("top_values", column=a.column, k=a.k)
        elif a.step == "head":
            out = out.then("limit", n=a.n)
        elif a.step == "sql":
            out = out.then("sql", query=a.query)
        elif a.step == "run":
            out = out.then("run", name=a.name, args=a.args)
        elif a.step == "store" and a.path:
            out = out.then("store", path=a.path, single_file=True)
        elif a.step == "view":
            out = out.then("limit", n=a.n)
        elif a.step in ("describe", "nulls"):
            out = out.then(a.step)
    return out


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    arrow = "--output=arrow" in argv
    steps = parse([a for a in argv if a not in ("--output=arrow", "--output=csv")])
    folder = os.environ.get("MILLRACE_PLUGINS", os.path.expanduser("~/.millrace/plugins"))
    history = os.environ.get("MILLRACE_HISTORY", os.path.expanduser("~/.millrace/history.jsonl"))
    load_plugins(folder)
    if steps[-1].step == "save":
        kept = pipeline_of(steps[:-1])
        if steps[-1].last:
            runs = logged_runs(history, 1)
            if not runs:
                raise SystemExit("no run is logged")
            kept = Pipeline.from_json(json.dumps(runs[0]["steps"]))
        print(kept.save_as_plugin(steps[-1].name, folder, steps[-1].desc))
        return 0
    if steps[0].step == "history":
        print("\n".join(f"{r['at']} {r['command']}" for r in logged_runs(history, steps[0].n)))
        return 0
    if steps[0].step == "plugins":
        print("\n".join(f"{p.name:<20} {p.desc} {p.args}".rstrip() for p in PLUGINS.values()))
        return 0
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    first = steps[0]
    if first.step == "load" and first.schema_preview:
        for f in preview_schema(spark, first.source, first.format):
            print(f"{f.name}: {f.dataType.simpleString()}")
        return 0
    starts = first.step in ("run", "sql", "join") or (first.step == "load" and first.source)
    df = None if starts else read_lines(spark, sys.stdin.read().splitlines())
    pipeline = pipeline_of(steps)
    log_run(history, argv, pipeline)
    out = pipeline.build(spark, df)
    last = steps[-1]
    if last.step == "view":
        print(render(out, last.n))
    elif arrow:
        print_arrow(out)
    elif last.step != "store" or not last.path:
        print_csv(out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
