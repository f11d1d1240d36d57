"""Command line: ``python -m tunelake <job> --root <folder> …``; also usable with spark-submit."""

from __future__ import annotations

import argparse
import sys

from tunelake.plans import jobs
from tunelake.plans.patterns import all_passed
from tunelake.schemas import RAW
from tunelake.session import build_session
from tunelake.sinks.store import Store
from tunelake.sources.tables import day_range, read_raw


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--root", required=True, help="folder of the stored tables")
    common.add_argument("--env", default="dev", help="prod, or any other name for dev_ schemas")

    parser = argparse.ArgumentParser(prog="tunelake", description=__doc__)
    job = parser.add_subparsers(dest="job", required=True)
    load = job.add_parser("load", parents=[common], help="load landed pages up to yesterday")
    load.add_argument("--landing", required=True, help="folder of landed pages, one per table")
    load.add_argument("--start-date", help="first day, YYYY-MM-DD; yesterday by default")
    load.add_argument("--dry-run", action="store_true", help="only show the days")
    stays = {"action": "store_true", "help": "an event's key never changes its day"}
    load.add_argument("--day-in-key", **stays)
    fill = job.add_parser("backfill", parents=[common], help="load a history of raw tables")
    fill.add_argument("--history", required=True, help="folder of raw Parquet tables")
    fill.add_argument("--start-date", required=True)
    fill.add_argument("--end-date", help="last day; yesterday by default")
    fill.add_argument("--skip-reference", action="store_true", help="leave the dimensions alone")
    fill.add_argument("--day-in-key", **stays)
    job.add_parser("index", parents=[common], help="index the events by key, for merges")
    job.add_parser("build", parents=[common], help="rebuild the marts")
    job.add_parser("test", parents=[common], help="run the data tests")
    job.add_parser("check", parents=[common], help="run the pattern checks")
    job.add_parser("report", parents=[common], help="count the rows of all tables")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """Run a job; 0 if it succeeded and, for tests and checks, if they all passed."""
    args = parse(argv)
    if args.job in ("load", "backfill"):
        try:
            first, last = day_range(args.start_date, getattr(args, "end_date", None))
        except ValueError as error:
            print(error, file=sys.stderr)
            return 1
        print(f"days {first} to {last}")
        if getattr(args, "dry_run", False):
            return 0

    spark = build_session()
    store = Store(spark, args.root, args.env)
    if args.job == "load":
        jobs.daily_load(store, args.landing, args.start_date, day_in_key=args.day_in_key)
    elif args.job == "backfill":
        history = {t: read_raw(spark, f"{args.history}/{t}", t) for t in RAW}
        jobs.backfill(store, history, args.start_date, args.end_date, args.skip_reference,
                      day_in_key=args.day_in_key)
    elif args.job == "index":
        store.index_keys()
    elif args.job == "build":
        jobs.build(store)
    elif args.job == "test":
        failed = jobs.test(store).where("not passed").collect()  # at most one row per test
        for row in failed:
            print(f"{row.model}.{row.column} {row.test}: {row.n_failed} failed")
        return 1 if failed else 0
    elif args.job == "check":
        summary = jobs.check(store).collect()  # one row per check
        for row in summary:
            print(f"{row.status} {row.check}: {row.value}, expected {row.threshold}")
        return 0 if all_passed(summary) else 1
    if args.job in ("backfill", "report"):
        jobs.row_report(store).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
