"""Command line: ``spark-submit ... tillmark/__main__.py`` or ``python -m tillmark``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tillmark.operators.matching import NULL_ZIPS
from tillmark.plans import jobs
from tillmark.sources import readers


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tillmark")
    commands = parser.add_subparsers(dest="command", required=True)

    index = commands.add_parser("index", help="store files to index panel")
    index.add_argument("--store-path", required=True)
    index.add_argument("--out", required=True)
    index.add_argument("--format", default="parquet", help="a format that Spark reads and writes")
    index.add_argument("--weight-basis", default="fiscal", choices=["fiscal", "calendar"])
    index.add_argument("--index-kind", default="price", choices=["price", "qty"])
    index.add_argument("--preset", choices=sorted(jobs.PRESETS))
    index.add_argument("--limit", type=int, help="only the N smallest store ids")
    index.add_argument("--contract", default="enforce", choices=jobs.CONTRACT_MODES)
    index.add_argument("--order-column", help="row order inside a store-product-month")
    index.add_argument("--unique-months", action="store_true", help="there is one row per month")
    index.add_argument("--per-store", action="store_true", help="also one output per store")
    index.add_argument("--timestamps", action="store_true", help="months as timestamps")

    panel = commands.add_parser("panel", help="per-store indexes, of any runs, to index panel")
    panel.add_argument("--store-index", required=True, help="folder with one folder per store")
    panel.add_argument("--out", required=True, help="where the panel goes")
    panel.add_argument("--format", default="parquet", help="a format that Spark reads and writes")
    panel.add_argument("--index-kind", default="price", choices=["price", "qty"])
    panel.add_argument("--timestamps", action="store_true", help="months as timestamps")

    match = commands.add_parser("match", help="letters and store master to candidate list")
    match.add_argument("--letters", required=True)
    match.add_argument("--stores", required=True)
    match.add_argument("--out", required=True)
    match.add_argument("--zip5", action="store_true", help="cut ZIP+4 codes to five digits")
    match.add_argument(
        "--null-zip", default="keep-apart", choices=NULL_ZIPS, help="what missing ZIPs match"
    )
    match.add_argument("--date-format", default="yyyy-MM-dd", help="of the letters' dates")
    match.add_argument("--multi-line", action="store_true", help="cells may hold line breaks")
    match.add_argument(
        "--malformed",
        default="fail",
        choices=readers.MALFORMED,
        help="letter rows of another form: fail, or list them and go on without",
    )

    treat = commands.add_parser("treat", help="reviewed matches onto an index panel")
    treat.add_argument("--panel", required=True)
    treat.add_argument("--reviewed", required=True, help="CSV with a 0/1 column 'matching'")
    treat.add_argument("--out", required=True)
    treat.add_argument("--format", default="parquet", help="a format that Spark reads and writes")

    check = commands.add_parser("validate", help="check sample tables if present")
    check.add_argument("--store")
    check.add_argument("--index")
    check.add_argument("--format", default="parquet", help="a format that Spark reads and writes")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tillmark {args.command}").getOrCreate()
    if args.command == "index":
        preset = jobs.PRESETS.get(args.preset) or jobs.IndexPreset(
            args.index_kind, args.weight_basis
        )
        panel = jobs.index_job(
            spark,
            readers.read_store_table(spark, args.store_path, args.format),
            args.out,
            preset.index_kind,
            preset.weight_basis,
            limit=args.limit,
            contract=args.contract,
            order_col=args.order_column,
            unique_months=args.unique_months,
            per_store=args.per_store,
            fmt=args.format,
            timestamps=args.timestamps,
        )
        print(f"panel rows: {panel.count():,}")
    elif args.command == "panel":
        panel = jobs.panel_job(
            spark, args.store_index, args.out, args.index_kind, fmt=args.format, timestamps=args.timestamps
        )
        print(f"panel rows: {panel.count():,}")
    elif args.command == "match":
        options = {"date_format": args.date_format, "multi_line": args.multi_line}
        if args.malformed != "fail":
            found = readers.letter_violations(spark, args.letters, **options)
            print(f"letter rows left out or undated: {jobs.quarantine_job(found, args.out):,}")
            # a cell that is no date is missing then, not an error
        letters = readers.read_letters_csv(spark, args.letters, malformed=args.malformed, **options)
        stores = readers.read_store_master(spark, args.stores, multi_line=args.multi_line)
        result = jobs.match_job(
            spark, stores, letters, args.out, zip5=args.zip5, null_zip=args.null_zip
        )
        print(f"letters: {result['letters']:,}, candidate pairs: {result['pairs']:,}")
        print(result["summary"])
    elif args.command == "treat":
        reviewed = readers.read_reviewed_sheet(spark, args.reviewed)
        panel = readers.read_store_table(spark, args.panel, args.format)
        print(jobs.treatment_job(spark, panel, reviewed, args.out, args.format))
    else:
        tables = [
            readers.read_if_present(spark, path, args.format) for path in (args.store, args.index)
        ]
        print(jobs.validate_job(*tables))


if __name__ == "__main__":
    main()
