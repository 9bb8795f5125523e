"""Command line: ``python -m palimpsest.cli --log PATH COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone
from importlib import import_module

from pyspark.sql import SparkSession

from .operators.blame import format_blame
from .operators.revert import reverted
from .plans.policy import grant_admin, revoke_writes
from .plans.registry import Registry, declared
from .sources.store import Engine, write_json_lines
from .spec import Capture


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest")
    top.add_argument("--log", required=True, help="folder of the log")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    plan = sub.add_parser("plan")
    plan.add_argument("table")
    plan.add_argument("--only", nargs="*")
    plan.add_argument("--exclude", nargs="*")
    plan.add_argument("--condition")
    plan.add_argument("--output")
    sub.add_parser("partitions").add_argument("--months", type=int, default=3)
    sub.add_parser("status")
    sub.add_parser("chain-enable", help="chain every event from here on")
    sub.add_parser("tree-enable", help="put every event from here on into the history tree")
    sub.add_parser("tree-root", help="size and root of the history tree, to be noted elsewhere")
    tree = sub.add_parser("tree-verify")
    tree.add_argument("--root", help="JSON of a size and root that were noted before")
    tree.add_argument("--limit", type=int, default=1000, help="broken rows that are listed")
    sub.add_parser("index-enable", help="index the log's files")
    frame = sub.add_parser("keyframe", help="keep the state of a table at the beginning of a month")
    frame.add_argument("table")
    frame.add_argument("month")
    merge = sub.add_parser("merge", help="make one batch of a month's many")
    merge.add_argument("--until-commit", type=int)
    merge.add_argument("--at-least", type=int, default=8)
    sub.add_parser("vacuum").add_argument("--admin", action="store_true", required=True)
    apply = sub.add_parser("apply", help="install the captures that a module declares")
    apply.add_argument("module")
    apply.add_argument("--prune", action="store_true")
    apply.add_argument("--dry-run", action="store_true")
    policy = sub.add_parser("policy")
    policy.add_argument("role")
    policy.add_argument("--admin", dest="grant", action="store_true")
    verify = sub.add_parser("chain-verify")
    verify.add_argument("--tip", help="JSON of a tip that was noted before")
    purge = sub.add_parser("purge")
    purge.add_argument("older_than")
    purge.add_argument("--drop-partitions", action="store_true")
    purge.add_argument("--dry-run", action="store_true")
    purge.add_argument("--admin", action="store_true", help="needed unless it is a dry run")
    blame = sub.add_parser("blame")
    blame.add_argument("table")
    blame.add_argument("object_id")
    blame.add_argument("--field")
    blame.add_argument("--limit", type=int, default=200)
    blame.add_argument("--format", choices=("text", "json"), default="text")
    as_of = sub.add_parser("as-of")
    as_of.add_argument("table")
    as_of.add_argument("at")
    as_of.add_argument("--id")
    as_of.add_argument("--limit", type=int)
    revert = sub.add_parser("revert")
    revert.add_argument("source", help="Parquet of the table")
    revert.add_argument("output")
    revert.add_argument("record_id")
    revert.add_argument("log_id", type=int)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    engine = Engine(spark, args.log, admin=getattr(args, "admin", False))
    now = datetime.now(timezone.utc)
    if args.command == "init":
        engine.bootstrap()
    elif args.command == "plan":
        text = Capture(args.table, columns=tuple(args.only) if args.only else None, without=tuple(args.exclude or ()), where=args.condition).plan().text
        if args.output:
            with open(args.output, "w") as f:
                f.write(text)
        else:
            print(text)
    elif args.command == "partitions":
        for name, start, end in engine.partition_bounds(now, args.months):
            print(name, start.date(), end.date())
    elif args.command == "status":
        print(json.dumps(engine.status() | {"captures": [r.asDict() for r in Registry(engine).installed.orderBy("name").collect()]}, default=str))
    elif args.command == "policy":
        print(";\n".join(grant_admin("log", args.role, "contexts") if args.grant else revoke_writes("log", args.role, "contexts")))
    elif args.command == "chain-enable":
        engine.bootstrap()
        engine.enable_chain()
    elif args.command == "tree-enable":
        engine.bootstrap()
        engine.enable_tree()
    elif args.command == "tree-root":
        print(json.dumps(engine.tree_root()))
    elif args.command == "tree-verify":
        broken = engine.verify_tree(json.loads(args.root) if args.root else None).orderBy("id", "reason").limit(args.limit).collect()
        print(json.dumps({"ok": not broken, "broken": [[r["id"], r["reason"]] for r in broken]}))
        return 1 if broken else 0
    elif args.command == "index-enable":
        engine.bootstrap()
        engine.enable_index()
    elif args.command == "keyframe":
        engine.write_keyframe(args.table, args.month)
    elif args.command == "merge":
        print(" ".join(engine.merge_batches(args.until_commit, args.at_least) + engine.merge_side_tables(args.at_least)))
    elif args.command == "vacuum":
        print(engine.vacuum())
    elif args.command == "apply":
        import_module(args.module)
        registry = Registry(engine)
        if args.dry_run:
            for row in registry.pending(declared(), args.prune).orderBy("name").toLocalIterator():
                print(row["action"], row["name"])
        else:
            print(json.dumps(registry.apply(declared(), args.prune)))
    elif args.command == "chain-verify":
        result = engine.verify(json.loads(args.tip) if args.tip else None)
        print(json.dumps(result))
        return 0 if result["ok"] else 1
    elif args.command == "purge":
        print(engine.drop_old_months(now, args.older_than, args.dry_run) if args.drop_partitions else engine.purge(now, args.older_than, args.dry_run, keep_anchor=True))
    elif args.command == "blame":
        print(format_blame(engine.blame(args.table, args.object_id, args.field, args.limit), args.table, args.object_id, args.format))
    elif args.command == "as-of":
        rows = engine.row_as_of(args.table, args.id, args.at) if args.id else engine.as_of(args.table, args.at)
        for line in write_json_lines(rows, limit=args.limit):
            print(line)
    elif args.command == "revert":
        reverted(spark.read.parquet(args.source), engine.log, args.record_id, args.log_id).write.parquet(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
