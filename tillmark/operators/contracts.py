"""Declared table contracts: columns, types, nullability, ranges, uniqueness.

A contract is checked with one aggregation over the table (plus one grouped
count when it has a key); only the violation counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillmark.functions.numeric import is_infinite
from tillmark.operators.panel import duplicate_keys
from tillmark.operators.price_index import DEFAULT_LABEL, index_columns


FLOATING = ("double", "float")


class ContractError(ValueError):
    """A table breaks its contract; the message lists every broken rule."""


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str
    nullable: bool = False
    at_least: float | None = None
    finite: bool = False

    def known(self, source: str) -> Column:
        """Is there a value?  NaN counts as missing."""
        c = F.col(self.name)
        return c.isNotNull() & ~F.isnan(c) if source in FLOATING else c.isNotNull()

    def value(self, source: str) -> Column:
        """The column in its declared type; NULL where it cannot be converted.

        A column that needs nothing stays a bare reference, so that filters on
        it still reach the scan.
        """
        c = F.col(self.name)
        if source in FLOATING:
            c = F.when(self.known(source), c)
            if self.dtype == "string":
                # a whole number is written in plain digits, as from an integer column
                whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
                return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
        return c if source == self.dtype else c.try_cast(self.dtype)

    def broken(self, source: str) -> Iterator[tuple[str, Column]]:
        value, known = self.value(source), self.known(source)
        if source != self.dtype and self.dtype != "string":
            yield "coercion", known & value.isNull()
        if not self.nullable:
            yield "not_null", ~known
        if self.at_least is not None:
            yield f"at_least_{self.at_least:g}", value < self.at_least
        if self.finite:
            yield "finite", is_infinite(value)


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    closed: bool = False
    key: tuple[str, ...] = ()

    def structure(self, df: DataFrame) -> list[tuple[str, str]]:
        """(column, rule) for absent columns and, if closed, for extra ones."""
        wanted = [f.name for f in self.fields]
        problems = [(n, "missing_column") for n in wanted if n not in df.columns]
        if self.closed:
            problems += [(n, "extra_column") for n in df.columns if n not in wanted]
        return problems

    def coerce(self, df: DataFrame) -> DataFrame:
        """Declared types; a closed contract also fixes the column set."""
        types = dict(df.dtypes)
        declared = {f.name: f.value(types[f.name]) for f in self.fields if f.name in types}
        return df.select(
            *[
                declared.get(c, F.col(c)).alias(c)
                for c in df.columns
                if c in declared or not self.closed
            ]
        )

    def row_rules(self, df: DataFrame, rows: Column | None = None) -> list[tuple[str, str, Column]]:
        """(column, rule, aggregate that counts violations); ``rows`` restricts it to some rows."""
        types = dict(df.dtypes)
        wanted = F.lit(True) if rows is None else rows
        return [
            (f.name, rule, F.count_if(F.coalesce(wanted & test, F.lit(False))))
            for f in self.fields
            if f.name in types
            for rule, test in f.broken(types[f.name])
        ]

    def rule_counts(self, df: DataFrame, rows: Column | None = None) -> Column:
        """Aggregate: array of (column, rule, violations), zeros included.

        ``rows`` restricts the check to some rows.  Uniqueness is not part of it.
        """
        counts = self.row_rules(df, rows)
        counts += [(c, rule, F.lit(1).cast("long")) for c, rule in self.structure(df)]
        return F.array(*[_rule(*r) for r in counts])

    def violations(self, df: DataFrame) -> DataFrame:
        """One row per rule (contract, column, rule, violations), zeros included."""
        # the row count keeps this an aggregation even when no rule counts rows
        counted = df.agg(F.count(F.lit(1)).alias("__rows"), self.rule_counts(df).alias("__rules"))
        result = counted.select(F.lit(self.name).alias("contract"), F.inline("__rules"))
        if self.key and all(k in df.columns for k in self.key):
            surplus = duplicate_keys(df, self.key).agg(
                F.coalesce(F.sum(F.col("row_count") - 1), F.lit(0)).alias("__n")
            )
            unique = F.array(_rule(",".join(self.key), "unique", F.col("__n")))
            result = result.unionByName(
                surplus.select(F.lit(self.name).alias("contract"), F.inline(unique))
            )
        return result

    def fail_on(self, violations: DataFrame) -> None:
        """Raise if a table of (column, rule, violations) has a count above zero."""
        found = violations.filter(F.col("violations") > 0).collect()
        self.fail_on_counts([(r["column"], r["rule"], r["violations"]) for r in found])

    def fail_on_counts(self, counts: Iterable[tuple[str, str, int]]) -> None:
        """Raise if one of (column, rule, violations) is above zero."""
        text = "; ".join(f"{column}: {rule} x{n}" for column, rule, n in counts if n)
        if text:
            raise ContractError(f"{self.name}: {text}")

    def enforce(self, df: DataFrame) -> DataFrame:
        """The coerced table, or :class:`ContractError` if any rule is broken."""
        self.fail_on(self.violations(df))
        return self.coerce(df)


def _rule(column: str, rule: str, count: Column) -> Column:
    return F.struct(
        F.lit(column).alias("column"), F.lit(rule).alias("rule"), count.alias("violations")
    )


# The input table's columns (types after lower-casing names).
_REQUIRED = {
    "store_id": "bigint",
    "calendar_year": "bigint",
    "calendar_month": "bigint",
    "gtin": "string",
    "quantity": "double",
    "quantity_with_discount": "double",
    "transaction_count": "bigint",
    "transaction_count_with_discount": "bigint",
    "total_revenue_amount": "double",
    "scan_type": "string",
    "q_plus_qwd": "double",
}
_OPTIONAL = {
    "nonscan_category": "string",
    "nonscan_subcategory": "string",
    "nonscan_detail": "string",
    "category": "string",
    "subcategory": "string",
    "manufacturer": "string",
    "brand": "string",
    "product_type": "string",
    "sub_product_type": "string",
    "unit_size": "string",
    "pack_size": "string",
    "product_description": "string",
    "unit_value_q_plus_qwd": "double",
    "unit_value_q": "double",
}

STORE_CONTRACT = Contract(
    "store",
    tuple(Field(n, t) for n, t in _REQUIRED.items())
    + tuple(Field(n, t, nullable=True) for n, t in _OPTIONAL.items()),
)


def index_contract(index_kind: str = "price", label: str = DEFAULT_LABEL) -> Contract:
    """Closed contract of an index table or panel."""
    level, log = index_columns(index_kind, label)
    return Contract(
        f"{index_kind}_index",
        (
            Field("store_id", "bigint"),
            Field("date", "date"),
            Field(level, "double", nullable=True, at_least=0, finite=True),
            Field(log, "double", nullable=True, finite=True),
        ),
        closed=True,
        key=("store_id", "date"),
    )
