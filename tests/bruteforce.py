"""The index formula worked out row by row in plain Python, for small tables."""

from __future__ import annotations

import math
from collections import defaultdict


def power(base, exponent):
    """C pow with NaN for missing, without Python's exceptions."""
    if exponent == 0 or base == 1:
        return 1.0
    if math.isnan(base) or math.isnan(exponent):
        return math.nan
    try:
        value = math.pow(base, exponent)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.inf if base == 0 else math.nan
    return value


def divide(a, b):
    if b != 0:
        return a / b
    return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)


def usable(x):
    return x if math.isfinite(x) and x > 0 else None


def product(terms):
    known = [t for t in terms if t is not None and not math.isnan(t)]
    return math.prod(known) if known else None


def index(rows, value, period):
    """{(store, month number): index} from dicts in file order."""
    product_revenue = defaultdict(float)
    type_revenue = defaultdict(float)
    category_revenue = defaultdict(float)
    series = defaultdict(list)
    for row in rows:
        store, kind, item = row["store_id"], row["product_type"], row["gtin"]
        year, money = row[period], row["total_revenue_amount"]
        product_revenue[store, kind, item, year] += money
        type_revenue[store, kind, year] += money
        if year is not None:
            category_revenue[store, year] += money
        series[store, item].append(row)

    terms = defaultdict(list)
    for (store, item), sales in series.items():
        before = None
        for row in sorted(sales, key=lambda r: r["month"]):
            ratio = math.nan
            if before and row["month"] - before["month"] == 1:
                if row[value] is not None and before[value] is not None:
                    ratio = divide(row[value], before[value])
            kind, year = row["product_type"], row[period]
            weight = divide(product_revenue[store, kind, item, year], type_revenue[store, kind, year])
            terms[store, kind, row["month"], year].append(usable(power(ratio, weight)))
            before = row

    by_month = defaultdict(list)
    for (store, kind, month, year), factors in terms.items():
        level = product(factors)
        level = math.nan if level is None or usable(level) is None else level
        weight = math.nan
        if year is not None:
            weight = divide(type_revenue[store, kind, year], category_revenue[store, year])
        by_month[store, month].append(power(level, weight))
    result = {}
    for key, factors in by_month.items():
        level = product(factors)
        result[key] = None if level is None else usable(level)
    return result
