"""Command line: run, ask, watch, sync, bookmarks, report, workspace, perf."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from lumenspan.plans import lenses, report, specs, sync, workspace
from lumenspan.plans.lens import Config, Lens
from lumenspan.session import local_session


def perf(spark, config: Config, root: str, cap_s: float) -> dict:
    """Seconds to parse a tree, and to find all flows from entrypoints to exitpoints; jobs are cancelled at the cap."""
    import threading

    timer = threading.Timer(cap_s, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        c = lenses.Context(spark, config, Lens("entry-to-exit", source_root=root, params={"entry": r"@\w*(Mapping|Listener|Scheduled)", "exit": r"\.(save|send|publish)\s*\("}))
        t = time.time()
        n = c.parsed.count()
        built = time.time()
        flows = lenses.entry_to_exit_plan(c).count()
        return {"files": n, "build_s": round(built - t, 2), "query_s": round(time.time() - built, 2), "flows": flows}
    finally:
        timer.cancel()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lumenspan")
    p.add_argument("--config", default="config.json")
    p.add_argument("--cores", type=int, default=8)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("run", help="all configured lenses, or one given here")
    one.add_argument("--analyzer")
    one.add_argument("--root", default="")
    one.add_argument("--out", default="")
    one.add_argument("params", nargs="*", metavar="key=value")
    q = sub.add_parser("ask", help="a question by its id")
    q.add_argument("id")
    q.add_argument("--root", default="")
    q.add_argument("values", nargs="*", metavar="key=value")
    s = sub.add_parser("sync")
    s.add_argument("files", nargs="*")
    sub.add_parser("bookmarks")
    w = sub.add_parser("watch")
    w.add_argument("--rounds", type=int, default=0)
    r = sub.add_parser("report")
    r.add_argument("--out", default="report.html")
    r.add_argument("params", nargs="*", metavar="key=value")
    ws = sub.add_parser("workspace")
    ws.add_argument("action", choices=["list", "add", "remove", "tables", "symbols"])
    ws.add_argument("args", nargs="*")
    pf = sub.add_parser("perf")
    pf.add_argument("--root", default="")
    pf.add_argument("--timeout", type=float, default=300)
    a = p.parse_args(argv)
    config = Config.load(a.config) if Path(a.config).exists() else Config()
    pairs = lambda xs: dict(x.split("=", 1) for x in xs)
    if a.command == "sync":
        for f in a.files or map(str, sorted((Path(config.root) / config.projections_dir).glob("*.projection"))):
            print(f, sync.sync(config, f))
        return 0
    if a.command == "bookmarks":
        print(*sync.expand_drop_ins(config), sep="\n")
        return 0
    if a.command == "workspace" and a.action in ("list", "add", "remove"):
        if a.action == "add":
            workspace.add(config, *a.args)
        elif a.action == "remove":
            workspace.remove(config, *a.args)
        if a.action != "list":
            config.save(a.config)
        print(json.dumps({k: [r.__dict__ for r in v] for k, v in config.projects.items()}, indent=1))
        return 0
    spark = local_session(a.cores)
    if a.command == "run" and a.analyzer:
        lens = Lens(a.analyzer, source_root=a.root, out=a.out, params=pairs(a.params))
        got = lenses.run(spark, config, lens)
        print(*got.write(f"{config.root}/{a.out}"), sep="\n") if a.out else print(got.body())
    elif a.command == "run":
        print(*lenses.run_all(spark, config), sep="\n")
    elif a.command == "ask":
        print((got := specs.ask(spark, config, a.id, a.root, **pairs(a.values)))["body"], f"confidence: {got['confidence']}", sep="\n")
    elif a.command == "watch":
        from lumenspan.streaming.trees import follow_tree

        for told in follow_tree(spark, config, rounds=a.rounds or None):
            print(json.dumps(told))
    elif a.command == "report":
        Path(a.out).write_text(report.page(lenses.run(spark, config, Lens("service-graph", params=pairs(a.params)))))
        print(a.out)
    elif a.command == "workspace":
        print(json.dumps(workspace.tables_view(spark, config, *a.args) if a.action == "tables" else workspace.symbols(spark, config, *a.args), indent=1))
    else:
        print(json.dumps(perf(spark, config, a.root, a.timeout)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
