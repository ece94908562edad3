"""Store-level price and quantity indexes, letter matching and treatment on Spark."""

from tillmark.functions.calendar import FiscalCalendar
from tillmark.functions.similarity import similarity_score
from tillmark.operators.contracts import STORE_CONTRACT, Contract, ContractError, index_contract
from tillmark.operators.lags import value_lags
from tillmark.operators.matching import match_candidates, prep_letters, prep_stores, zip_candidates
from tillmark.operators.panel import duplicate_keys, keep_first, union_all
from tillmark.operators.prepare import (
    filter_subcategory,
    limit_stores,
    prepare_store,
    store_status,
)
from tillmark.operators.price_index import geo_index, store_index, type_index
from tillmark.operators.treatment import assign_treatment, confirmed_matches, treatment_counts
from tillmark.operators.weights import revenue_weights, type_weight_table

__all__ = [
    "STORE_CONTRACT",
    "Contract",
    "ContractError",
    "FiscalCalendar",
    "assign_treatment",
    "confirmed_matches",
    "duplicate_keys",
    "filter_subcategory",
    "geo_index",
    "index_contract",
    "keep_first",
    "limit_stores",
    "match_candidates",
    "prep_letters",
    "prep_stores",
    "prepare_store",
    "revenue_weights",
    "similarity_score",
    "store_index",
    "store_status",
    "treatment_counts",
    "type_index",
    "type_weight_table",
    "union_all",
    "value_lags",
    "zip_candidates",
]
