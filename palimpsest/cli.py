"""A small command line over one store: python -m palimpsest.cli PATH COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from .errors import StoreError

COMMANDS = {
    "put": ["key", "value"],
    "get": ["key"],
    "range": ["key", "offset", "length"],
    "head": ["key"],
    "delete": ["key"],
    "scan": ["prefix"],
    "history": ["key"],
    "get-at": ["key", "revision"],
    "prune-history": ["keep"],
    "import": ["key", "file"],
    "gen": ["key", "generator", "params"],
    "inspect": ["key"],
    "train-dict": ["prefix"],
    "train-template": ["prefix"],
    "vacuum": [],
    "version": [],
    "sources": [],
    "stats": [],
    "verify": [],
    "gc": [],
    "compact": [],
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="palimpsest")
    out.add_argument("path")
    commands = out.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        one = commands.add_parser(name)
        for a in arguments:
            one.add_argument(a, type=int if a in ("offset", "length", "revision", "keep", "generator") else bytes.fromhex if a == "params" else str)
        if name in ("get", "range", "get-at"):
            one.add_argument("--out", help="a file for the bytes, exactly as they are")
            one.add_argument("--hex", action="store_true")
        if name == "scan":
            one.add_argument("--limit", type=int, default=0)
            one.add_argument("--reverse", action="store_true")
    return out


def run(store, a: argparse.Namespace) -> int:
    """0, or 1 where a key is missing or the store is not in order."""
    from .functions.keys import prefix_bounds
    from .operators import maintenance

    key = a.key.encode() if hasattr(a, "key") else b""
    found: object = None
    if a.command == "put":
        found = store.put(key, a.value.encode())
    elif a.command == "get":
        found = store.get(key)
    elif a.command == "range":
        found = store.get_range(key, a.offset, a.length)
    elif a.command == "head":
        found = store.head(key)
    elif a.command == "delete":
        found = store.delete(key) or None
    elif a.command == "get-at":
        found = store.get_at(key, a.revision)
    elif a.command == "prune-history":
        found = store.prune_history(a.keep)
    elif a.command == "import":
        found = store.import_file(key, a.file)
    elif a.command == "gen":
        found = store.put_generated(key, a.generator, 1, a.params)
    elif a.command in ("train-dict", "train-template"):
        found = store.train("zstd_dict" if a.command == "train-dict" else "template", prefix=a.prefix.encode())
    elif a.command == "vacuum":
        found = store.vacuum()
    elif a.command == "version":
        found = store._commit()["meta"]["version"]
    elif a.command == "gc":
        found = store.gc()
    elif a.command == "compact":
        store.compact()
        return 0
    else:
        rows = {
            "scan": lambda: store.scan(*prefix_bounds(a.prefix.encode()), a.reverse, a.limit, with_values=False),
            "history": lambda: store.history(key),
            "inspect": lambda: store.inspect(key),
            "sources": store.sources,
            "stats": store.stats,
            "verify": store.verify,
        }[a.command]()
        for r in rows.toLocalIterator():
            print("\t".join(bytes(v).decode("utf-8", "backslashreplace") if isinstance(v, bytearray | bytes) else str(v) for v in r))
        return int(a.command == "verify" and not maintenance.is_ok(rows))
    if found is None:
        return 1
    if isinstance(found, bytes) and a.out:
        with open(a.out, "wb") as f:
            f.write(found)
    elif isinstance(found, bytes):
        print(found.hex() if a.hex else found.decode("utf-8", "backslashreplace"))
    else:
        print(found)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)  # usage errors end here, before a store is opened
    from pyspark.sql import SparkSession

    from .plans.store import Store

    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    try:
        return run(Store(spark, a.path), a)
    except StoreError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
