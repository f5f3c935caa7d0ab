"""Command line: python -m trawl.cli COMMAND ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from trawl.database import Database
from trawl.operators import chunkers
from trawl.plans.options import Options, keep_rare, keep_rarest
from trawl.sources.files import as_json, as_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trawl", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x, **({"nargs": "*"} if x.endswith("s") else {}))
        return c

    c = command("create", "db")
    c.add_argument("--case-insensitive", action="store_true")
    c.add_argument("--alias", action="append", default=[], help="two characters: the first is taken for the second")
    c = command("stale", "db", "paths")
    c.add_argument("--refresh", action="store_true", help="reindex stale files")
    command("compact", "db")
    for name in ("add", "reindex"):
        command(name, "db", "paths").add_argument("--strategy", default="line")
    command("remove", "db", "paths")
    for name in ("search", "bench"):
        c = command(name, "db")
        for flag in ("--contains", "--regex", "--fuzzy"):
            c.add_argument(flag)
        for flag in ("--loose", "--verify"):
            c.add_argument(flag, action="store_true")
        c.add_argument("--score", choices=["coverage", "density", "overlap", "bm25"])
        c.add_argument("--ratio", type=float)
        c.add_argument("--best", type=int)
        c.add_argument("--except-regex", action="append", default=[])
        c.add_argument("--proximity", type=int, default=0)
        c.add_argument("-k", type=int, default=20)
        c.add_argument("-n", type=int, default=100)
    command("score", "db", "query", "path").add_argument("--score", choices=["coverage", "density", "overlap", "bm25"])
    c = command("chunks", "db", "path", "location")
    c.add_argument("--before", type=int, default=0)
    c.add_argument("--after", type=int, default=0)
    command("strategy", "db", "action", "name").add_argument("--run", default="")
    command("chunk", "strategy", "path")
    for kind in ("lines", "words"):
        c = command(f"chunk-{kind}-overlap", "path")
        c.add_argument("--size", type=int, default=50 if kind == "lines" else 200)
        c.add_argument("--overlap", type=int, default=10 if kind == "lines" else 50)
    return p


def results(db: Database, args: argparse.Namespace):
    choose = keep_rare(args.ratio) if args.ratio is not None else keep_rarest(args.best) if args.best is not None else None
    options = Options(loose=args.loose, scoring=args.score, trigram_filter=choose, verify=args.verify, except_regex=tuple(args.except_regex), proximity=args.proximity)
    if args.fuzzy is not None:
        return db.search_fuzzy(args.fuzzy, args.k, options)
    if args.contains is not None:
        return db.search(args.contains, Options(**{**vars(options), "regex": (args.regex,) if args.regex else ()}))
    if args.regex is not None:
        return db.search_regex(args.regex, options)
    raise SystemExit("one of --contains, --regex and --fuzzy is needed")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Prints lines, and returns them."""
    args = parser().parse_args(argv)
    if args.command.startswith("chunk") and args.command != "chunks":
        name = args.strategy if args.command == "chunk" else f"{args.command.split('-')[1]}-{args.size}-{args.overlap}"
        with open(args.path, "rb") as f:
            out = [f"{c['location']}\t{c['content']}" for c in chunkers.named(name).chunks(f.read())]
        print(*out, sep="\n")
        return out
    spark = spark or SparkSession.builder.appName("trawl").getOrCreate()
    out: list[str] = []
    if args.command == "create":
        Database.create(spark, args.db, args.case_insensitive, {a[0]: a[1] for a in args.alias if len(a) == 2})
    else:
        db = Database.open(spark, args.db)
        if args.command == "add":
            db.add_paths(*args.paths, strategy=args.strategy)
        elif args.command == "reindex":
            from trawl.sources.files import read_files

            db.reindex(read_files(spark, *args.paths), args.strategy)
        elif args.command == "remove":
            db.remove(*args.paths)
        elif args.command == "stale":
            found = db.refresh_paths(*args.paths) if args.refresh else db.check_paths(*args.paths)
            out = [f"{r.status}\t{r.path}" for r in found.where("status <> 'fresh'").orderBy("path").toLocalIterator()]
        elif args.command == "compact":
            db.compact()
        elif args.command == "search":
            out = [r.value for r in as_lines(results(db, args)).toLocalIterator()]
        elif args.command == "bench":
            began = time.monotonic()
            for _ in range(args.n):
                results(db, args).count()
            out = [f"{args.n} searches, {(time.monotonic() - began) / max(args.n, 1) * 1000:.1f} ms each"]
        elif args.command == "score":
            from pyspark.sql import functions as F

            scored = db.score_file(args.query, args.path, Options(scoring=args.score)).withColumn("path", F.lit(args.path))
            out = [r.value for r in as_lines(scored, scores=True).toLocalIterator()]
        elif args.command == "chunks":
            out = [r.value for r in as_json(db.get_chunks(args.path, args.location, args.before, args.after)).toLocalIterator()]
        elif args.command == "strategy":
            if args.action == "add":
                db.add_strategy(args.name, args.run)
            elif args.action == "remove":
                db.remove_strategy(args.name)
            out = db.registry.names()
    print(*out, sep="\n")
    return out


if __name__ == "__main__":
    main()
