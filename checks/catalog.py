"""Registered queries with the SQL that states the same result.

Every query reads whole tables.  Sums and products of floating-point numbers
may run in any order, so they are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import sql_views as sql, views
from tillmark.functions.similarity import similarity_score, token_sorted
from tillmark.functions.text import basic_clean, expand_street_words
from tillmark.operators import lags, matching, panel, prepare, price_index, treatment, weights
from tillmark.operators.contracts import STORE_CONTRACT, index_contract
from tillmark.sources.scratch import stored_counted

Query = Callable[[SparkSession, str], DataFrame]
LABEL = price_index.DEFAULT_LABEL
PERIOD = prepare.PERIOD_COLUMNS
VALUE = prepare.VALUE_COLUMNS


@dataclass(frozen=True)
class Entry:
    """A query and its SQL.

    ``dates`` are handed over as ISO text and ``gaps`` (integers with missing
    values) as doubles on both sides, so that either engine yields the same
    Python values whichever way its rows are fetched.
    """

    run: Query
    oracle: str | None = None
    dates: tuple[str, ...] = ()
    gaps: tuple[str, ...] = ()

    def neutral(self) -> Entry:
        casts = {c: "string" for c in self.dates} | {c: "double" for c in self.gaps}
        if not casts:
            return self

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = self.run(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})

        names = {"string": "VARCHAR", "double": "DOUBLE"}
        replaced = ", ".join(f"CAST({c} AS {names[t]}) AS {c}" for c, t in casts.items())
        return Entry(run, f"SELECT * REPLACE ({replaced}) FROM ({self.oracle})")


DATE = ("date",)
FISCAL_YEAR = ("fiscal_year",)
LETTER_DATES = matching.LETTER_DATES


def _r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared rows of the subcategory, one per store, product and month."""
    return prepare.filter_subcategory(
        prepare.prepare_store(views.scanner(spark, sf_dir), views.FISCAL)
    )


def _kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.filter_subcategory(
        prepare.prepare_store(views.scanner_lines(spark, sf_dir), views.FISCAL)
    )


def _index(kind: str, basis: str, lines: bool = False) -> Entry:
    level, log = price_index.index_columns(kind)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if lines:
            rows = _kept_lines(spark, sf_dir)
            index = price_index.geo_index(rows, basis, kind, order_col="row_no")
        else:
            index = price_index.geo_index(_kept(spark, sf_dir), basis, kind, unique_months=True)
        return index.select("store_id", "date", _r6(level), _r6(log))

    text = sql.index_ctes(VALUE[kind], PERIOD[basis], lines)
    return Entry(
        run,
        f"{text} SELECT store_id, date, round(level, 6) AS {level},"
        f" round(log_level, 6) AS {log} FROM store_index",
        DATE,
    )


def _type_index() -> Entry:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        types = price_index.type_index(_kept(spark, sf_dir), "calendar", "price", unique_months=True)
        keys = ["store_id", "subcategory", "product_type", "date"]
        return types.select(*keys, _r6("type_index"), _r6("stage_2_weight"))

    return Entry(
        run,
        sql.index_ctes("unit_value_q", "calendar_year")
        + " SELECT store_id, subcategory, product_type, date, round(type_index, 6) AS type_index,"
        " round(stage_2_weight, 6) AS stage_2_weight FROM type_index",
        DATE,
    )


def _value_lags(lines: bool = False, unique: bool = False) -> Entry:
    columns = ["store_id", "gtin", "date", "month_diff"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if lines:
            df = lags.value_lags(_kept_lines(spark, sf_dir), "unit_value_q", order_col="row_no")
        else:
            # the value is all that is asked for, so no other column is carried along
            rows = _kept(spark, sf_dir).select("store_id", "gtin", "date", "unit_value_q")
            df = lags.value_lags(rows, "unit_value_q", unique_months=unique)
        return df.select(*columns, "value", "lag_value")

    order = ", l_orderkey, l_linenumber, l_partkey" if lines else ""
    text = ",".join(
        [
            "WITH" + (sql.LINES if lines else sql.SCANNER),
            sql.PREPARED,
            sql.LAGGED.format(value="unit_value_q", order=order),
        ]
    )
    return Entry(
        run,
        f"{text} SELECT {', '.join(columns)}, value, lag_value FROM lagged",
        DATE,
        ("month_diff",),
    )


def _revenues() -> dict[str, Entry]:
    period = "fiscal_year"
    head = "WITH" + ",".join([sql.SCANNER, sql.PREPARED, sql.REVENUES.format(period=period)])
    keys = {
        "category": "store_id, subcategory",
        "type": "store_id, subcategory, product_type",
        "product": "store_id, subcategory, product_type, gtin",
    }

    def entry(level: str) -> Entry:
        amount = f"{level}_annual_revenue"

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            table = getattr(weights.revenue_weights(_kept(spark, sf_dir), period), level)
            return table.select(*keys[level].split(", "), period, _r6(amount))

        return Entry(
            run,
            f"{head} SELECT {keys[level]}, period AS {period}, round({amount}, 6) AS {amount}"
            f" FROM {level}_revenue",
            gaps=FISCAL_YEAR,
        )

    return {f"revenue_{level}": entry(level) for level in keys}


def _joined_weights() -> dict[str, Entry]:
    period = "fiscal_year"
    head = "WITH" + ",".join(
        [sql.SCANNER, sql.PREPARED, sql.REVENUES.format(period=period), sql.WEIGHTS]
    )

    def stage_1(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _kept(spark, sf_dir)
        shares = weights.stage_1_weights(weights.revenue_weights(rows, period), period)
        return weights.attach_stage_1(rows, shares, period).select(
            "store_id", "product_type", "gtin", "date", period, _r6("stage_1_weight")
        )

    def stage_2(spark: SparkSession, sf_dir: str) -> DataFrame:
        totals = weights.revenue_weights(_kept(spark, sf_dir), period)
        return weights.stage_2_weights(totals, period).select(
            "store_id", "product_type", period, _r6("stage_2_weight")
        )

    def on_index(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _kept(spark, sf_dir)
        types = price_index.type_index(rows, "fiscal", "qty", unique_months=True)
        dated = types.drop("stage_2_weight").join(
            weights.period_of_month(rows, period), "date", "left"
        )
        shares = weights.stage_2_weights(weights.revenue_weights(rows, period), period)
        return weights.attach_stage_2(dated, shares, period).select(
            "store_id", "product_type", "date", period, _r6("type_index"), _r6("stage_2_weight")
        )

    return {
        "stage1_weights_joined": Entry(
            stage_1,
            f"{head} SELECT k.store_id, k.product_type, k.gtin, k.date, k.{period},"
            " round(s.stage_1_weight, 6) AS stage_1_weight FROM kept k LEFT JOIN stage_1 s"
            " ON k.store_id = s.store_id AND k.subcategory = s.subcategory AND k.gtin = s.gtin"
            " AND k.product_type IS NOT DISTINCT FROM s.product_type"
            f" AND k.{period} IS NOT DISTINCT FROM s.period",
            DATE,
            FISCAL_YEAR,
        ),
        "stage2_weights_joined": Entry(
            stage_2,
            f"{head} SELECT store_id, product_type, period AS {period},"
            " round(stage_2_weight, 6) AS stage_2_weight FROM stage_2",
            gaps=FISCAL_YEAR,
        ),
        "stage2_weights_on_type_index": Entry(
            on_index,
            sql.index_ctes("quantity", period)
            + f" SELECT t.store_id, t.product_type, t.date, d.{period},"
            " round(t.type_index, 6) AS type_index, round(t.stage_2_weight, 6) AS stage_2_weight"
            f" FROM type_index t LEFT JOIN (SELECT DISTINCT date, {period} FROM kept) d USING (date)",
            DATE,
            FISCAL_YEAR,
        ),
    }


def _month_periods() -> Entry:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return weights.period_of_month(_kept(spark, sf_dir), "fiscal_year")

    head = "WITH" + ",".join([sql.SCANNER, sql.PREPARED])
    return Entry(run, f"{head} SELECT DISTINCT date, fiscal_year FROM kept", DATE, FISCAL_YEAR)


def _fiscal_year() -> Entry:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        line = views.table(spark, sf_dir, "lineitem")
        month = F.trunc(F.col("l_shipdate").cast("date"), "MM")
        return line.select(
            "l_orderkey", "l_linenumber", "l_partkey", month.alias("date"),
            views.FISCAL.fiscal_year(month).alias("fiscal_year"),
        )

    return Entry(
        run,
        "SELECT l_orderkey, l_linenumber, l_partkey,"
        " CAST(date_trunc('month', l_shipdate) AS DATE) AS date,"
        " CASE WHEN l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '2000-07-01'"
        " THEN CAST(year(l_shipdate + INTERVAL 6 MONTH) AS INTEGER) END AS fiscal_year FROM lineitem",
        DATE,
        FISCAL_YEAR,
    )


def _prepare_store() -> Entry:
    numbers = ["quantity", "quantity_with_discount", "total_revenue_amount", "unit_value_q"]
    plain = ["store_id", "gtin", "date", "fiscal_year", "product_type", "subcategory"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        upper = views.scanner(spark, sf_dir)
        upper = upper.toDF(*[c.upper() for c in upper.columns])
        df = prepare.prepare_store(upper, views.FISCAL)
        return df.select(*plain, "transaction_count", *numbers)

    head = "WITH" + ",".join([sql.SCANNER, sql.PREPARED])
    columns = ", ".join([*plain, "transaction_count", *numbers])
    return Entry(run, f"{head} SELECT {columns} FROM prepared", DATE, FISCAL_YEAR)


def _store_counts() -> dict[str, Entry]:
    def status(spark: SparkSession, sf_dir: str) -> DataFrame:
        return prepare.store_status(views.patchy_scanner(spark, sf_dir))

    def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = F.col("store_id")
        known = views.scanner(spark, sf_dir).withColumn("store_id", F.when(store % 3 != 0, store))
        rows = prepare.limit_stores(known, 10)
        return rows.groupBy("store_id").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.round(F.sum("total_revenue_amount"), 4).alias("revenue"),
        )

    head = "WITH" + sql.SCANNER
    return {
        "store_status": Entry(
            status,
            f"""{head}, relabelled AS (
              SELECT store_id, CASE WHEN store_id % 7 = 0 THEN 'NONSCAN' ELSE scan_type END AS scan_type,
                     CASE WHEN store_id % 7 <> 0 AND store_id % 5 = 0 THEN 'Other' ELSE subcategory END AS subcategory
              FROM scanner),
            patchy AS (
              SELECT *, scan_type = 'GTIN' AS is_product,
                     scan_type = 'GTIN' AND subcategory = 'Vaping Products' AS is_kept
              FROM relabelled)
            SELECT store_id, count(*) AS rows_read,
                   count(*) FILTER (WHERE is_product) AS product_rows,
                   count(*) FILTER (WHERE is_kept) AS subcategory_rows,
                   CASE WHEN count(*) FILTER (WHERE is_product) = 0 THEN 'no_gtin'
                        WHEN count(*) FILTER (WHERE is_kept) = 0 THEN 'no_subcategory'
                        ELSE 'processed' END AS status
            FROM patchy GROUP BY store_id""",
        ),
        "limit_stores": Entry(
            limited,
            f"""{head} SELECT store_id, count(*) AS row_count,
                   round(sum(total_revenue_amount), 4) AS revenue FROM scanner
            WHERE store_id IN (SELECT DISTINCT store_id FROM scanner WHERE store_id % 3 <> 0
                               ORDER BY store_id LIMIT 10)
            GROUP BY store_id""",
        ),
    }


def _contracts() -> dict[str, Entry]:
    def good(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = prepare.prepare_store(views.scanner(spark, sf_dir), views.FISCAL)
        return STORE_CONTRACT.violations(df)

    def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
        return STORE_CONTRACT.violations(views.faulty_scanner(spark, sf_dir))

    def index(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index_contract("price").violations(views.faulty_index(spark, sf_dir, LABEL))

    def qty_index(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index_contract("qty").violations(views.faulty_index(spark, sf_dir, LABEL, "qty"))

    def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
        return panel.duplicate_keys(views.faulty_index(spark, sf_dir, LABEL))

    broken = {
        "gtin": "gtin = 'Brand#13'",
        "transaction_count": "transaction_count > 1",
        "quantity": "calendar_month = 7",
    }
    # The columns of the input that must hold a value
    required = [
        "store_id", "calendar_year", "calendar_month", "gtin", "quantity", "quantity_with_discount",
        "transaction_count", "transaction_count_with_discount", "total_revenue_amount", "scan_type",
        "q_plus_qwd",
    ]
    # in the scanner view these columns do not have the declared type
    narrow = ["calendar_year", "calendar_month"]

    def rules(source: str, cases: list[tuple[str, str, str]]) -> str:
        """One SQL row per rule: (column, rule, condition)."""
        return " UNION ALL ".join(
            f"SELECT '{source}' AS contract, '{c}' AS \"column\", '{r}' AS rule,"
            f" count(*) FILTER (WHERE {w}) AS violations FROM checked"
            for c, r, w in cases
        )

    not_null = [
        (c, "not_null", broken.get(c, f"{c} IS NULL")) for c in required if c != "transaction_count"
    ]
    coerced = [(c, "coercion", f"{c} IS NOT NULL AND try_cast({c} AS BIGINT) IS NULL") for c in narrow]
    faulty_cases = (
        not_null
        + coerced
        + [
            ("transaction_count", "not_null", "transaction_count IS NULL"),
            ("transaction_count", "coercion", broken["transaction_count"]),
        ]
    )
    good_cases = [(c, "not_null", f"{c} IS NULL") for c in required] + coerced
    inf = "'Infinity'::DOUBLE"
    index_cte = f"""WITH{sql.SCANNER}, checked AS (
        SELECT CASE WHEN store_id % 9 > 0 THEN store_id END AS store_id,
               CAST(make_date(calendar_year, calendar_month, 1) AS DATE) AS date,
               CASE WHEN store_id % 10 = 0 THEN {inf} ELSE unit_value_q - 1500.0 END AS v,
               CASE WHEN store_id % 10 = 1 THEN -{inf} ELSE unit_value_q - 1500.0 END AS lv
        FROM scanner),
      repeated AS (SELECT store_id, date, count(*) AS row_count FROM checked
                   GROUP BY store_id, date HAVING count(*) > 1)"""

    def index_rules(kind: str) -> str:
        level, log = f"{LABEL}_{kind}_index", f"l_{LABEL}_{kind}_index"
        counted = rules(
            f"{kind}_index",
            [
                ("store_id", "not_null", "store_id IS NULL"),
                ("date", "not_null", "date IS NULL"),
                (level, "at_least_0", "v < 0"),
                (level, "finite", f"v IN ({inf}, -{inf})"),
                (log, "finite", f"lv IN ({inf}, -{inf})"),
            ],
        )
        return (
            f"{index_cte} {counted}"
            f" UNION ALL SELECT '{kind}_index', 'note', 'extra_column', 1"
            f" UNION ALL SELECT '{kind}_index', 'store_id,date', 'unique',"
            " CAST(coalesce(sum(row_count - 1), 0) AS BIGINT) FROM repeated"
        )

    return {
        "contract_input_clean": Entry(
            good,
            f"WITH{sql.SCANNER}, checked AS (SELECT * FROM scanner WHERE scan_type = 'GTIN') "
            + rules("store", good_cases),
        ),
        "contract_input_violations": Entry(
            faulty,
            f"WITH{sql.SCANNER}, checked AS (SELECT * FROM scanner) "
            + rules("store", faulty_cases)
            + " UNION ALL SELECT 'store', 'pack_size', 'missing_column', 1",
        ),
        "contract_index_violations": Entry(index, index_rules("price")),
        "contract_qty_violations": Entry(qty_index, index_rules("qty")),
        "duplicate_keys": Entry(
            duplicates,
            f"{index_cte} SELECT store_id, date, row_count FROM repeated",
            DATE,
            ("store_id",),
        ),
    }


def _panels() -> dict[str, Entry]:
    def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _kept(spark, sf_dir).groupBy("store_id", "date").agg(F.sum("quantity").alias("level"))

    def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
        once = monthly(spark, sf_dir)
        return panel.keep_first(panel.union_all([once, once]))

    def first(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _kept_lines(spark, sf_dir).select(
            "store_id", "date", "row_no", F.col("unit_value_q").alias("level")
        )
        return panel.keep_first(rows, order_col="row_no").drop("row_no")

    def union(spark: SparkSession, sf_dir: str) -> DataFrame:
        once = monthly(spark, sf_dir)
        return panel.union_all([once, once])

    base = f"WITH{sql.SCANNER},{sql.PREPARED}, once AS (SELECT store_id, date,"
    base += " sum(quantity) AS level FROM kept GROUP BY store_id, date)"
    return {
        "panel_dedup": Entry(dedup, f"{base} SELECT * FROM once", DATE),
        "panel_keep_first": Entry(
            first,
            f"WITH{sql.LINES},{sql.PREPARED} SELECT store_id, date,"
            " arg_min(unit_value_q, (l_orderkey, l_linenumber, l_partkey)) AS level"
            " FROM kept GROUP BY store_id, date",
            DATE,
        ),
        "union_all": Entry(
            union, f"{base} SELECT * FROM once UNION ALL SELECT * FROM once", DATE
        ),
    }


STORE_COLUMNS = "store_id, store_name, store_chain_name_pdi, address, zip_code"
CANDIDATES = ", ".join(matching.candidate_columns())


def _matching() -> dict[str, Entry]:
    def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching.prep_stores(views.store_master(spark, sf_dir))

    def stores_zip5(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching.prep_stores(views.store_master(spark, sf_dir), zip5=True)

    def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching.prep_letters(views.letters(spark, sf_dir))

    def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching.zip_candidates(stores(spark, sf_dir), letters(spark, sf_dir))

    def joined_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching.zip_candidates(
            matching.prep_stores(views.store_master(spark, sf_dir), null_zip="join"),
            matching.prep_letters(views.letters(spark, sf_dir), null_zip="join"),
        )

    def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching.match_candidates(stores(spark, sf_dir), letters(spark, sf_dir))

    def top(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching.top_matches(stores(spark, sf_dir), letters(spark, sf_dir), 10)

    def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
        written, seen = stored_counted(scored(spark, sf_dir), "scored-pairs", matching.score_counts())
        return matching.rank_candidates(written, matching.ScoreCounts.of(seen))

    def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = matching.score_summary(scored(spark, sf_dir))
        return df.select(*[c if c == "count" else _r6(c) for c in df.columns])

    def words(text: str) -> str:
        clean = sql.basic_clean_sql(text)
        return sql.street_words_sql(clean)

    head = f"WITH RECURSIVE {sql.STORES.strip()},{sql.LETTERS.split(',', 0)[0]}"
    ready = f""",
      s AS (SELECT *, {words("address")} AS clean FROM stores),
      l AS (SELECT *, {words("address")} AS clean FROM letters),
      sw AS (SELECT *, {sql.token_sorted_sql("clean")} AS words_a FROM s),
      lw AS (SELECT *, {sql.token_sorted_sql("clean")} AS words_b FROM l),
      pairs AS (
        SELECT sw.clean AS address_pdi, lw.clean AS address_fda, sw.store_id,
               sw.store_name AS store_name_pdi, sw.store_chain_name_pdi,
               lw.store_name AS store_name_fda, lw.insp_date, lw.issue_date, sw.zip_code,
               words_a, words_b
        FROM sw LEFT JOIN lw ON sw.zip_code = lw.zip_code
      ),{sql.BLOCK_RATIO},
      result AS (
        SELECT {CANDIDATES}, CASE WHEN words_a IS NULL OR words_b IS NULL THEN NULL
               WHEN words_a = words_b THEN 100 WHEN words_a = '' OR words_b = '' THEN 0
               ELSE score END AS similarity_score
        FROM pairs LEFT JOIN scored ON top_a = words_a AND top_b = words_b
      )"""
    order = f"similarity_score DESC NULLS LAST, {', '.join(c + ' ASC NULLS FIRST' for c in matching.candidate_columns())}"
    return {
        "stores_prep": Entry(stores, f"WITH{sql.STORES} SELECT {STORE_COLUMNS} FROM stores"),
        "stores_prep_zip5": Entry(
            stores_zip5,
            f"WITH{sql.STORES} SELECT store_id, store_name, store_chain_name_pdi, address,"
            " regexp_replace(zip_code, '-.*', '') AS zip_code FROM stores",
        ),
        "letters_prep": Entry(
            letters,
            f"WITH{sql.STREETS},{sql.LETTERS} SELECT {', '.join(matching.LETTER_COLUMNS)} FROM letters",
            LETTER_DATES,
        ),
        "zip_candidates": Entry(
            candidates,
            f"{head} SELECT s.address AS address_pdi, l.address AS address_fda, s.store_id,"
            " s.store_name AS store_name_pdi, s.store_chain_name_pdi,"
            " l.store_name AS store_name_fda, l.insp_date, l.issue_date, s.zip_code"
            " FROM stores s LEFT JOIN letters l ON s.zip_code = l.zip_code",
            LETTER_DATES,
        ),
        "zip_candidates_null_join": Entry(
            joined_candidates,
            f"{head} SELECT s.address AS address_pdi, l.address AS address_fda, s.store_id,"
            " s.store_name AS store_name_pdi, s.store_chain_name_pdi,"
            " l.store_name AS store_name_fda, l.insp_date, l.issue_date,"
            " coalesce(s.zip_code, 'nan') AS zip_code FROM stores s LEFT JOIN letters l"
            " ON coalesce(s.zip_code, 'nan') = coalesce(l.zip_code, 'nan')",
            LETTER_DATES,
        ),
        "address_similarity": Entry(
            scored,
            f"{head}{ready} SELECT {CANDIDATES}, similarity_score FROM result",
            LETTER_DATES,
            ("similarity_score",),
        ),
        "similarity_ranked": Entry(
            ranked,
            f"{head}{ready} SELECT {CANDIDATES}, similarity_score FROM result ORDER BY {order}",
            LETTER_DATES,
            ("similarity_score",),
        ),
        "similarity_top": Entry(
            top,
            f"{head}{ready} SELECT {CANDIDATES}, similarity_score FROM result"
            f" ORDER BY {order} LIMIT 10",
            LETTER_DATES,
        ),
        "similarity_summary": Entry(
            summary,
            f"""{head}{ready} SELECT count(similarity_score) AS count,
              round(avg(similarity_score), 6) AS mean, round(stddev_samp(similarity_score), 6) AS std,
              CAST(min(similarity_score) AS DOUBLE) AS min,
              round(quantile_cont(similarity_score, 0.25), 6) AS p25,
              round(quantile_cont(similarity_score, 0.5), 6) AS p50,
              round(quantile_cont(similarity_score, 0.75), 6) AS p75,
              CAST(max(similarity_score) AS DOUBLE) AS max FROM result""",
        ),
    }


def _texts() -> dict[str, Entry]:
    def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
        ours = views.store_master(spark, sf_dir).select(F.col("STREET_ADDRESS").alias("address"))
        theirs = views.letters(spark, sf_dir).select(F.col("Address").alias("address"))
        return ours.unionAll(theirs)

    def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = views.table(spark, sf_dir, "documents")
        return docs.select("doc_id", basic_clean(F.col("text")).alias("clean"))

    def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
        address = F.col("address")
        return addresses(spark, sf_dir).select(
            "address",
            basic_clean(address).alias("clean"),
            expand_street_words(basic_clean(address)).alias("expanded"),
        )

    def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
        # every benchmark item against the next one: texts of up to 400 characters
        items = views.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"))
        after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
        a, b = basic_clean(F.col("a")), basic_clean(F.col("b"))
        return items.join(after, "item_id").select(
            "item_id",
            F.length(token_sorted(a)).cast("long").alias("chars"),
            similarity_score(a, b).alias("score"),
        )

    def sort_words(spark: SparkSession, sf_dir: str) -> DataFrame:
        address = F.col("address")
        words = token_sorted(expand_street_words(basic_clean(address)))
        return addresses(spark, sf_dir).select("address", words.alias("words"))

    both = (
        f"WITH{sql.STORES_RAW},{sql.LETTERS_RAW}, addresses AS (SELECT address FROM stores_raw"
        " UNION ALL SELECT address FROM letters_raw)"
    )
    cleaned = sql.basic_clean_sql("address")
    expanded = sql.street_words_sql(cleaned)
    return {
        "address_basic_clean": Entry(
            clean, f"SELECT doc_id, {sql.basic_clean_sql('text')} AS clean FROM documents"
        ),
        "address_expand": Entry(
            expand, f"{both} SELECT address, {cleaned} AS clean, {expanded} AS expanded FROM addresses"
        ),
        "similarity_long_texts": Entry(
            long_texts,
            f"""WITH RECURSIVE pairs AS (
              SELECT i.item_id, {sql.token_sorted_sql(sql.basic_clean_sql("i.text"))} AS words_a,
                     {sql.token_sorted_sql(sql.basic_clean_sql("j.text"))} AS words_b
              FROM benchmark i JOIN benchmark j ON j.item_id = i.item_id + 1
            ),{sql.BLOCK_RATIO}
            SELECT item_id, length(words_a) AS chars,
                   CAST(CASE WHEN words_a = words_b THEN 100 WHEN words_a = '' OR words_b = '' THEN 0
                        ELSE score END AS INTEGER) AS score
            FROM pairs LEFT JOIN scored ON top_a = words_a AND top_b = words_b""",
        ),
        "token_sorted": Entry(
            sort_words,
            f"{both} SELECT address, {sql.token_sorted_sql(expanded)} AS words FROM addresses",
        ),
    }


def _treatments() -> dict[str, Entry]:
    level, log = price_index.index_columns("qty")

    def treated(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = price_index.geo_index(_kept(spark, sf_dir), "fiscal", "qty", unique_months=True)
        reviewed = treatment.confirmed_matches(views.reviewed_matches(spark, sf_dir))
        return treatment.assign_treatment(index, reviewed)

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        return treated(spark, sf_dir).select(
            "store_id", "date", _r6(level), _r6(log), "insp_date", "issue_date", "insp", "issue"
        )

    def months(spark: SparkSession, sf_dir: str) -> DataFrame:
        reviewed = treatment.confirmed_matches(views.reviewed_matches(spark, sf_dir))
        return treatment.treatment_months(reviewed)

    def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return treatment.treatment_counts(treated(spark, sf_dir))

    months_cte = """treated_months AS (
          SELECT DISTINCT o_custkey // 15 AS store_id,
                 CAST(date_trunc('month', o_orderdate) AS DATE) AS insp_date,
                 CASE WHEN o_orderstatus <> 'O'
                      THEN CAST(date_trunc('month', o_orderdate + INTERVAL 60 DAY) AS DATE)
                 END AS issue_date
          FROM orders WHERE o_orderpriority = '1-URGENT')"""
    result = f"""{sql.index_ctes("quantity", "fiscal_year")}, {months_cte}, treated AS (
          SELECT i.store_id, i.date, round(i.level, 6) AS {level}, round(i.log_level, 6) AS {log},
                 m.insp_date, m.issue_date,
                 CASE WHEN m.insp_date IS NULL THEN 0 ELSE 1 END AS insp,
                 CASE WHEN m.issue_date IS NULL THEN 0 ELSE 1 END AS issue
          FROM store_index i LEFT JOIN treated_months m
            ON i.store_id = m.store_id AND i.date = m.insp_date)"""
    return {
        "treatment_months": Entry(
            months, f"WITH {months_cte} SELECT * FROM treated_months", LETTER_DATES
        ),
        "treatment_panel": Entry(
            shown, f"{result} SELECT * FROM treated", DATE + LETTER_DATES
        ),
        "treatment_counts": Entry(
            counts,
            f"{result} SELECT count(*) AS rows, count(DISTINCT (store_id, date)) AS store_months,"
            " CAST(sum(insp) AS BIGINT) AS insp_rows, CAST(sum(issue) AS BIGINT) AS issue_rows"
            " FROM treated",
        ),
    }


def catalog() -> dict[str, Entry]:
    entries = {
        f"index_{kind}_{basis}": _index(kind, basis) for kind in VALUE for basis in PERIOD
    }
    entries["index_price_calendar_lines"] = _index("price", "calendar", lines=True)
    entries["type_index"] = _type_index()
    entries["value_lags"] = _value_lags(unique=True)
    entries["value_lags_combined"] = _value_lags()
    entries["value_lags_lines"] = _value_lags(lines=True)
    entries |= _revenues()
    entries |= _joined_weights()
    entries["month_periods"] = _month_periods()
    entries["fiscal_year_assign"] = _fiscal_year()
    entries["prepare_store"] = _prepare_store()
    entries |= _store_counts()
    entries |= _contracts()
    entries |= _panels()
    entries |= _matching()
    entries |= _texts()
    entries |= _treatments()
    return {name: item.neutral() for name, item in entries.items()}
