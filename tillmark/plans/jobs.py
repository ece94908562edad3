"""The batch jobs, each a few writes with nothing but counts on the driver.

A result that several steps need is written once and read back: the steps share
it, and a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillmark.functions.calendar import DEFAULT_FISCAL_CALENDAR, FiscalCalendar
from tillmark.operators import matching, panel, prepare, price_index, treatment
from tillmark.operators.contracts import STORE_CONTRACT, index_contract
from tillmark.operators.weights import type_weight_table
from tillmark.session import tune
from tillmark.sources.scratch import observed
from tillmark.sources.sinks import (
    publish,
    with_timestamps,
    write_counted,
    write_index_per_store,
    write_review_sheet,
    write_table,
)


@dataclass(frozen=True)
class IndexPreset:
    index_kind: str
    weight_basis: str


# The four standard runs; any of them can be limited to N stores.
PRESETS = {
    "price_calendar": IndexPreset("price", "calendar"),
    "price_fiscal": IndexPreset("price", "fiscal"),
    "qty_calendar": IndexPreset("qty", "calendar"),
    "qty_fiscal": IndexPreset("qty", "fiscal"),
}
CONTRACT_MODES = ("enforce", "report", "skip")


def output_name(index_kind: str, weight_basis: str, label: str = price_index.DEFAULT_LABEL) -> str:
    prepare.value_column(index_kind)
    prepare.period_column(weight_basis)
    return f"{label}_{index_kind}_indexes_{weight_basis}"


def index_job(
    spark: SparkSession,
    raw: DataFrame,
    out_dir: str,
    index_kind: str = "price",
    weight_basis: str = "fiscal",
    limit: int | None = None,
    calendar: FiscalCalendar = DEFAULT_FISCAL_CALENDAR,
    subcategory: str = prepare.DEFAULT_SUBCATEGORY,
    label: str = price_index.DEFAULT_LABEL,
    contract: str = "enforce",
    order_col: str | None = None,
    unique_months: bool = False,
    per_store: bool = False,
    fmt: str = "parquet",
    timestamps: bool = False,
) -> DataFrame:
    """Raw store rows to the validated index panel of all stores.

    Writes below ``out_dir``: ``store_status`` (with the contract's rule counts per
    store, taken in the same scan), ``rows/<name>``, ``type_weights/<name>``,
    ``index/<name>``, ``index_panels/<name>``, and with ``per_store`` then also
    ``store_<name>``, where stores that this run does not process keep their
    folders; with ``limit`` first ``stores``, the chosen ids.
    ``contract="report"`` counts violations without stopping for them.
    ``timestamps`` writes the months of panel and stores as timestamps.

    The raw table is read twice (once more for the ids of a dry run): for the status
    with its checks, and for the few columns of the kept rows, which are written
    once and serve both the weights and the index.
    """
    name = output_name(index_kind, weight_basis, label)
    if contract not in CONTRACT_MODES:
        raise ValueError(f"contract must be one of {CONTRACT_MODES}")
    tune(spark)
    raw = prepare.lower_columns(raw)
    if limit is not None:
        if limit < 0:
            raise ValueError("limit must not be negative")
        chosen = write_table(prepare.smallest_stores(raw, limit), f"{out_dir}/stores")
        raw = raw.join(chosen, "store_id", "left_semi")
    rows = prepare.filter_subcategory(prepare.prepare_store(raw, calendar), subcategory)
    if contract == "skip":
        write_table(prepare.store_status(raw, subcategory), f"{out_dir}/store_status")
    else:
        checked = prepare.store_status(raw, subcategory, contract=STORE_CONTRACT)
        status = write_table(checked, f"{out_dir}/store_status")
        if contract == "enforce":
            STORE_CONTRACT.fail_on(prepare.total_violations(status))
        rows = STORE_CONTRACT.coerce(rows)
    rows = write_table(
        rows.select(*price_index.input_columns(weight_basis, index_kind, order_col)), f"{out_dir}/rows/{name}"
    )

    weights = write_table(
        type_weight_table(rows, prepare.period_column(weight_basis)),
        f"{out_dir}/type_weights/{name}",
    )
    index = price_index.geo_index(
        rows, weight_basis, index_kind, label, order_col, unique_months, weights
    )
    index = write_table(index, f"{out_dir}/index/{name}")
    built = build_panel(
        index, f"{out_dir}/index_panels/{name}", index_kind, label, fmt, timestamps
    )
    if per_store:
        write_index_per_store(with_timestamps(index, timestamps), f"{out_dir}/store_{name}", fmt)
    return built


def build_panel(
    index: DataFrame,
    path: str,
    index_kind: str = "price",
    label: str = price_index.DEFAULT_LABEL,
    fmt: str = "parquet",
    timestamps: bool = False,
    order_col: str | None = None,
) -> DataFrame:
    """One row per store and month, checked against the index contract.

    Of rows that share store and month the first stays, by ``order_col`` or else by
    value.  The index is read once: one aggregation keeps the first rows, which are
    unique by that, and the contract's rules are counted while they are written.
    The panel appears only if it has rows and breaks no rule; until then, and if it
    does not, an earlier one stays.
    """
    contract = index_contract(index_kind, label)
    given = index if order_col is None else index.drop(order_col)
    contract.fail_on_counts([(column, rule, 1) for column, rule in contract.structure(given)])
    unique = panel.keep_first(index, order_col=order_col)
    unique = unique if order_col is None else unique.drop(order_col)
    rules = {f"{i}": rule for i, rule in enumerate(contract.row_rules(unique))}
    metrics = {i: count for i, (_, _, count) in rules.items()} | {"rows": F.count(F.lit(1))}

    def accept(seen: dict[str, int]) -> None:
        if not seen["rows"]:
            raise RuntimeError("No store-level index rows to build a panel from")
        contract.fail_on_counts([(column, rule, seen[i]) for i, (column, rule, _) in rules.items()])

    watched, counts = observed(unique, metrics)
    declared = contract.coerce(watched).select(*[f.name for f in contract.fields])
    checked = with_timestamps(declared, timestamps)
    return publish(checked, path, counts, accept, fmt)


def panel_job(
    spark: SparkSession,
    store_index_path: str,
    path: str,
    index_kind: str = "price",
    label: str = price_index.DEFAULT_LABEL,
    fmt: str = "parquet",
    timestamps: bool = False,
) -> DataFrame:
    """The panel of all stores whose index lies below ``store_index_path``, whichever run wrote it.

    Of rows that share store and month the first in file order stays; formats
    without row numbers order the rows of a file by value.
    """
    tune(spark)
    found = spark.read.format(fmt).load(store_index_path)
    # an empty folder has no columns; the panel fails on its rows, not on these
    place = [F.col("_metadata.file_path")] + ([F.col("_metadata.row_index")] if fmt == "parquet" else [])
    placed = found.withColumn("__place", F.struct(*place))
    return build_panel(placed, path, index_kind, label, fmt, timestamps, order_col="__place")


def quarantine_job(violations: DataFrame, out_dir: str) -> int:
    """Writes the letter rows that break their form; returns how many there are."""
    rows = {"rows": F.count(F.lit(1))}
    return write_counted(violations, f"{out_dir}/warning_letters_violations", rows)[1]["rows"]


def match_job(
    spark: SparkSession,
    stores: DataFrame,
    letters: DataFrame,
    out_dir: str,
    null_token: str | None = "nan",
    zip5: bool = False,
    preview: int = 10,
    null_zip: str = "keep-apart",
) -> dict[str, Any]:
    """Raw letters and store master to the ranked candidate list for review.

    Writes the prepared stores, the letter panel, the scored pairs and the sorted review sheet.
    Scores are computed once, and counted while they are written: row counts and
    summary come from these counts, the sort is dealt out by them, and the preview
    reads only rows that can be in it.  Stores and letters without ZIP match nothing
    unless ``null_zip`` is ``join``.
    """
    tune(spark)
    rows = {"rows": F.count(F.lit(1))}
    letter_panel, letters_seen = write_counted(
        matching.prep_letters(letters, null_token, null_zip), f"{out_dir}/warning_letters_panel", rows
    )
    if not letters_seen["rows"]:
        raise ValueError("No warning letters found")
    prepared = write_table(
        matching.prep_stores(stores, null_token, zip5, null_zip=null_zip), f"{out_dir}/stores"
    )
    scored, seen = write_counted(
        matching.match_candidates(prepared, letter_panel),
        f"{out_dir}/warning_letters_scored",
        matching.score_counts(),
    )
    scores = matching.ScoreCounts.of(seen)
    write_review_sheet(matching.rank_candidates(scored, scores), f"{out_dir}/warning_letters_matched")
    best = scored if preview > scores.known else scored.where(F.col("similarity_score") >= scores.nth(preview))
    return {
        "letters": letters_seen["rows"],
        "pairs": scores.rows,
        "summary": scores.summary(),
        "top": [r.asDict() for r in matching.top_candidates(best, preview).collect()],
    }


def treatment_job(
    spark: SparkSession,
    index_panel: DataFrame,
    reviewed: DataFrame,
    out_dir: str,
    fmt: str = "parquet",
) -> dict[str, int]:
    """Reviewed matches onto an index panel; returns the row counts.

    The rows are counted while they are written; the panel has one per store and month
    by its contract.
    """
    tune(spark)
    confirmed = treatment.confirmed_matches(reviewed)
    treated = treatment.assign_treatment(index_panel, confirmed, mark_first=True)
    watched, seen = observed(treated, treatment.treated_rows())
    write_table(watched.drop(treatment.FIRST), f"{out_dir}/violators_insp_issue", fmt)
    return seen.get


def validate_job(
    store_rows: DataFrame | None = None, index_rows: DataFrame | None = None
) -> dict[str, str]:
    """Check whichever sample tables are given; raises on a broken contract."""
    outcome = {}
    if store_rows is None:
        outcome["store"] = "skipped"
    else:
        STORE_CONTRACT.enforce(prepare.lower_columns(store_rows))
        outcome["store"] = "valid"
    if index_rows is None:
        outcome["index"] = "skipped"
    else:
        index_contract("price").enforce(index_rows)
        outcome["index"] = "valid"
    return outcome
