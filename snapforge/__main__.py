"""python -m snapforge ROOT COMMAND: look into a snapshot, or move and clean its history. Results are JSON."""

from __future__ import annotations

import argparse
import json
import re
import sys
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import SparkSession

from snapforge.errors import SnapshotError
from snapforge.functions.keys import parse_key
from snapforge.operators.vector_snapshot import VectorSnapshot
from snapforge.sources.manifest import ManifestStore
from snapforge.sources.reader import Snapshot


def duration(text: str) -> timedelta:
    m = re.fullmatch(r"(\d+)([smhd])", text)
    if not m:
        raise argparse.ArgumentTypeError(f"not a duration such as 7d or 24h: {text}")
    return timedelta(seconds=int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="snapforge", description=__doc__)
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("get", "multiget", "route"):
        q = sub.add_parser(name)
        q.add_argument("keys", nargs="+" if name == "multiget" else 1)
        q.add_argument("--context", action="append", default=[], metavar="NAME=VALUE")
        q.add_argument("--form", choices=("base64", "hex", "utf8"), default="base64")
    for name in ("info", "shards"):
        sub.add_parser(name)
    sub.add_parser("health").add_argument("--stale-after", type=duration)
    sub.add_parser("history").add_argument("--limit", type=int, default=10)
    q = sub.add_parser("rollback")
    q.add_argument("--run-id")
    q.add_argument("--offset", type=int)
    q = sub.add_parser("cleanup")
    q.add_argument("--older-than", type=duration)
    q.add_argument("--keep-last", type=int)
    q.add_argument("--unpublished", action="store_true")
    q.add_argument("--delete", action="store_true", help="without it, runs are only listed")
    q = sub.add_parser("search")
    q.add_argument("vector", help="a JSON list")
    q.add_argument("--top-k", type=int, default=10)
    q.add_argument("--probes", type=int, default=1)
    sub.add_parser("exec", help="a JSON script: {on_error: stop or continue, commands: [[command, argument, ...], ...]}").add_argument("script")
    return p


def show(value: bytes | None, form: str) -> str | None:
    import base64

    return None if value is None else {"hex": value.hex, "utf8": lambda: value.decode("utf-8", "replace"), "base64": lambda: base64.b64encode(value).decode()}[form]()


def run(spark: SparkSession, args: argparse.Namespace) -> Any:
    root, store = args.root, ManifestStore(spark, args.root)
    if args.command in ("get", "multiget", "route"):
        snapshot = Snapshot(spark, root)
        keys = [parse_key(k, snapshot.manifest.key_encoding) for k in args.keys]
        context = dict(x.split("=", 1) for x in args.context) or None
        if args.command == "route":
            return {"key": args.keys[0], "shard": snapshot.route_key(keys[0], context)}
        found = snapshot.get_many(keys, context)
        return {text: show(found[k], args.form) for text, k in zip(args.keys, keys, strict=True)}
    if args.command == "info":
        return Snapshot(spark, root).info()
    if args.command == "shards":
        return [json.loads(x) for x in Snapshot(spark, root).shards().toJSON().collect()]
    if args.command == "health":
        return Snapshot(spark, root).health(args.stale_after.total_seconds() if args.stale_after else None)
    if args.command == "history":
        return [{"run_id": m.run_id, "created_at": m.created_at, "rows": m.rows_written, "current": m.run_id == store.current()} for m in store.manifests()[: args.limit]]
    if args.command == "rollback":
        return {"current": store.rollback(args.run_id, args.offset)}
    if args.command == "cleanup":
        cut = datetime.now(UTC) - args.older_than if args.older_than else None
        return {"deleted" if args.delete else "would_delete": store.clean(cut, args.keep_last, args.unpublished, not args.delete)}
    if args.command == "search":
        return [r.asDict() for r in VectorSnapshot(spark, root).search([json.loads(args.vector)], args.top_k, args.probes).orderBy("rank").collect()]
    with open(args.script) as f:
        script = json.load(f)
    out = []
    for command in script["commands"]:
        try:
            out.append({"command": command, "result": run(spark, parser().parse_args([root, *map(str, command)]))})
        except SnapshotError as error:
            out.append({"command": command, "error": str(error)})
            if script.get("on_error", "stop") == "stop":
                break
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("snapforge").getOrCreate()
    try:
        print(json.dumps(run(spark, args), default=str))
    except SnapshotError as error:
        print(json.dumps({"error": str(error), "retryable": error.retryable}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
