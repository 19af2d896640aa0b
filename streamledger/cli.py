"""Command line: emit, watch, get, list and sub. Results go to stdout, diagnostics to stderr; exit 0, 1 (the caller's to mend) or 2 (the environment's)."""

from __future__ import annotations

import argparse
import json
import os
import sys

from streamledger.errors import InvalidAddress, InvalidBound, InvalidEnvelope, LedgerError, UnknownEvent, UnreadableInput

ROOT = "STREAMLEDGER_ROOT"
DEFAULT_SOURCE = "app://streamledger"


def default_root() -> str:
    return os.environ.get(ROOT) or os.path.join(os.path.expanduser(os.environ.get("XDG_CONFIG_HOME") or "~/.config"), "streamledger")


def address(text: str, port: int = 1883) -> tuple[str, int]:
    """host or host:port; a malformed port is an error, never the default."""
    host, colon, given = text.rpartition(":") if ":" in text else (text, "", "")
    if not host:
        raise InvalidAddress(f"no host in {text!r}")
    if colon and not (given.isascii() and given.isdigit() and 0 < int(given) < 65536):
        raise InvalidAddress(f"no port: {given!r}")
    return host, int(given) if colon else port


def whole(text: str) -> int:
    try:
        return int(text)
    except ValueError as e:
        raise InvalidBound(f"no whole number: {text!r}") from e


class Parser(argparse.ArgumentParser):
    """A wrong call is the caller's to mend: exit 1."""

    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"error: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = Parser(prog="streamledger", description="A durable event ledger.")
    p.add_argument("--root", default=default_root(), help="where ledger, broker and subscriptions are kept")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, parent=verbs, **options):
        v = parent.add_parser(name, **options)
        v.add_argument("--json", action="store_true", help="one JSON document on stdout")
        return v

    emit = verb("emit", help="publish one event")
    emit.add_argument("type")
    emit.add_argument("--data", help="file with the data object, - for stdin; without it data is {}")
    emit.add_argument("--source")
    for name in ("correlation-id", "causation-id", "run-id", "producer", "traceparent"):
        emit.add_argument(f"--{name}")
    watch = verb("watch", help="history after a cursor, then the backlog")
    watch.add_argument("name")
    watch.add_argument("--since", default="0")
    watch.add_argument("--max", default="100")
    watch.add_argument("--timeout", default="30")
    watch.add_argument("--distinct", action="store_true", help="each event once")
    get = verb("get", help="one event by id")
    get.add_argument("id")
    listing = verb("list", help="newest events first")
    listing.add_argument("--type")
    listing.add_argument("--max", default="100")
    sub = verbs.add_parser("sub", help="durable subscriptions").add_subparsers(dest="what", required=True)
    add = verb("add", sub)
    add.add_argument("name")
    add.add_argument("pattern")
    add.add_argument("--owner")
    verb("list", sub)
    verb("show", sub).add_argument("name")
    remove = verb("remove", sub)
    remove.add_argument("name")
    remove.add_argument("--force", action="store_true")
    return p


def record(row) -> dict:
    """A ledger row in its stored form."""
    from streamledger.schema import FIELDS

    event = {wire: (json.loads(row[name]) if name == "data" else row[name]) for name, wire, _ in FIELDS if row[name] is not None}
    return {"storeFormatVersion": row["store_format_version"], "seq": row["seq"], "subscription": row["subscription"], "recordedAt": row["recorded_at"], "event": event}


def run(args: argparse.Namespace, spark) -> tuple[dict | list, list[str]]:
    """The result as JSON has it, and as lines of text."""
    from dataclasses import asdict

    from pyspark.sql import functions as F

    from streamledger.functions.envelope import Envelope
    from streamledger.operators.ledger import Ledger
    from streamledger.operators.pages import check_bound
    from streamledger.operators.registry import Registry
    from streamledger.schema import ENVELOPE
    from streamledger.streaming import drain

    line = lambda r: f"{r['subscription']} {r['seq']} {r['event']['id']} {r['event']['type']}"
    match args.verb, getattr(args, "what", None):
        case "emit", _:
            optional = {k: getattr(args, k) for k in ("correlation_id", "causation_id", "run_id", "producer", "traceparent")}
            made = Envelope.new(args.type, args.source or DEFAULT_SOURCE, read_data(args.data), **optional)
            row = spark.createDataFrame([made.row()], ENVELOPE).withColumn("time_order", F.lit(0))
            drain.emit(spark, args.root, row)
            return {"published": True, "event": made.to_dict()}, [f"published {made.id}"]
        case "watch", _:
            rows, told = drain.watch(spark, args.root, args.name, check_bound(whole(args.since), "since", 0), check_bound(whole(args.max)), float(args.timeout), args.distinct)
            records = [record(r) for r in rows]
            return {"subscription": args.name, "records": records, "cursor": told["cursor"], "hasMore": told["has_more"], "servedFrom": told["served_from"], "sessionPresent": told["session_present"], "consumed": told["consumed"], "skipped": told["skipped"], "stopped": told["stopped"]}, [line(r) for r in records]
        case "get", _:
            found = Ledger(spark, args.root).get(args.id).collect()
            if not found:
                raise UnknownEvent(f"no event {args.id}")
            one = record(found[0])
            return one, [json.dumps(one, ensure_ascii=False, indent=2)]
        case "list", _:
            records = [record(r) for r in Ledger(spark, args.root).list(args.type, check_bound(whole(args.max))).collect()]
            return {"events": records}, [line(r) for r in records]
        case "sub", "add":
            made = asdict(drain.add_subscription(spark, args.root, args.name, args.pattern, args.owner))
            return made, [f"{made['name']} {made['filter']}"]
        case "sub", "list":
            all_ = [asdict(s) for s in Registry(spark, args.root).list()]
            return {"subscriptions": all_}, [f"{s['name']} {s['pattern']}" for s in all_]
        case "sub", "show":
            one = asdict(Registry(spark, args.root).require(args.name))
            return one, [f"{k}: {v}" for k, v in one.items()]
        case _:
            gone = asdict(drain.remove_subscription(spark, args.root, args.name, args.force))
            return {"removed": gone["name"]}, [f"removed {gone['name']}"]


def read_data(source: str | None) -> object:
    """The data of an event: {} where no source is named, stdin for -, else a file. What can't be read, or is no JSON, is the caller's to mend."""
    if source is None:
        return {}
    try:
        if source == "-":
            return json.loads(sys.stdin.read())
        with open(source, encoding="utf-8") as f:
            return json.loads(f.read())
    except (OSError, ValueError) as e:
        raise UnreadableInput(f"data {source!r} can't be read as JSON: {e}") from e


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        if spark is None:
            from streamledger.session import session

            spark = session()
        result, lines = run(args, spark)
    except (LedgerError, OSError, ValueError) as e:
        told = {"error": type(e).__name__, "message": str(e), "remedy": getattr(e, "remedy", "")}
        if isinstance(e, InvalidEnvelope):
            told["errors"] = [vars(x) for x in e.errors]
        print(json.dumps(told) if args.json else f"error: {e}\n{told['remedy']}".rstrip(), file=sys.stderr)
        return getattr(e, "exit_code", 2)
    print(json.dumps(result, ensure_ascii=False) if args.json else "\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
