"""The views of ``checks/views.py`` as SQL common table expressions."""

from __future__ import annotations

SALES = """
sales AS (
  SELECT l_suppkey AS store_id, p_brand AS gtin,
         CAST(year(l_shipdate) AS INTEGER) AS calendar_year,
         CAST(month(l_shipdate) AS INTEGER) AS calendar_month,
         CASE WHEN l_returnflag = 'R' THEN 'NONSCAN' ELSE 'GTIN' END AS scan_type,
         l_quantity AS quantity,
         round(l_extendedprice * 100) * (100 - round(l_discount * 100)) AS amount,
         l_discount > 0 AS discounted,
         l_orderkey, l_linenumber, l_partkey,
         CAST(substr(p_brand, 7) AS INTEGER) AS brand_no
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

ATTRIBUTES = """
         CASE WHEN brand_no % 5 > 0 THEN 'Family ' || (brand_no % 5) END AS product_type,
         CASE WHEN brand_no <= 20 THEN 'Vaping Products' ELSE 'Other' END AS subcategory"""

SCANNER = (
    SALES
    + """,
monthly AS (
  SELECT store_id, gtin, brand_no, calendar_year, calendar_month, scan_type,
         sum(quantity) AS quantity,
         coalesce(sum(quantity) FILTER (WHERE discounted), 0.0) AS quantity_with_discount,
         count(*) AS transaction_count,
         count(*) FILTER (WHERE discounted) AS transaction_count_with_discount,
         sum(amount) / 10000 AS total_revenue_amount
  FROM sales GROUP BY ALL
),
scanner AS (
  SELECT * EXCLUDE (brand_no),"""
    + ATTRIBUTES
    + """,
         quantity + quantity_with_discount AS q_plus_qwd,
         total_revenue_amount / (quantity + quantity_with_discount) AS unit_value_q_plus_qwd,
         total_revenue_amount / quantity AS unit_value_q
  FROM monthly
)"""
)

LINES = (
    SALES
    + """,
scanner AS (
  SELECT *,"""
    + ATTRIBUTES
    + """,
         amount / 10000 AS total_revenue_amount,
         amount / 10000 / quantity AS unit_value_q
  FROM sales
)"""
)

FISCAL_YEAR = """CASE WHEN make_date(calendar_year, calendar_month, 1)
              BETWEEN DATE '1996-01-01' AND DATE '2000-06-01'
              THEN CAST(calendar_year + CASE WHEN calendar_month >= 7 THEN 1 ELSE 0 END AS INTEGER)
         END AS fiscal_year"""

PREPARED = f"""
prepared AS (
  SELECT *, CAST(make_date(calendar_year, calendar_month, 1) AS DATE) AS date,
         12 * calendar_year + calendar_month AS month_no,
         {FISCAL_YEAR}
  FROM scanner WHERE scan_type = 'GTIN'
),
kept AS (SELECT * FROM prepared WHERE subcategory = 'Vaping Products')"""

LAGGED = """
lagged AS (
  SELECT *, {value} AS value,
         CAST(month_no - lag(month_no) OVER w AS INTEGER) AS month_diff,
         CASE WHEN month_no - lag(month_no) OVER w = 1 THEN lag({value}) OVER w END AS lag_value
  FROM kept
  WINDOW w AS (PARTITION BY store_id, gtin ORDER BY month_no{order})
)"""

REVENUES = """
product_revenue AS (
  SELECT store_id, subcategory, product_type, gtin, {period} AS period,
         sum(total_revenue_amount) AS product_annual_revenue
  FROM kept GROUP BY ALL
),
type_revenue AS (
  SELECT store_id, subcategory, product_type, {period} AS period,
         sum(total_revenue_amount) AS type_annual_revenue
  FROM kept GROUP BY ALL
),
category_revenue AS (
  SELECT store_id, subcategory, {period} AS period,
         sum(total_revenue_amount) AS category_annual_revenue
  FROM kept WHERE {period} IS NOT NULL GROUP BY ALL
)"""

WEIGHTS = """
stage_1 AS (
  SELECT p.*, t.type_annual_revenue,
         p.product_annual_revenue / t.type_annual_revenue AS stage_1_weight
  FROM product_revenue p LEFT JOIN type_revenue t
    ON p.store_id = t.store_id AND p.subcategory = t.subcategory
   AND p.product_type IS NOT DISTINCT FROM t.product_type
   AND p.period IS NOT DISTINCT FROM t.period
),
stage_2 AS (
  SELECT t.*, c.category_annual_revenue,
         t.type_annual_revenue / c.category_annual_revenue AS stage_2_weight
  FROM type_revenue t LEFT JOIN category_revenue c
    ON t.store_id = c.store_id AND t.subcategory = c.subcategory AND t.period = c.period
)"""

# A missing operand is NaN here, for which the database's pow follows C.
TYPE_INDEX = """
terms AS (
  SELECT l.store_id, l.subcategory, l.product_type, l.date, l.{period} AS period,
         pow(coalesce(l.value / l.lag_value, 'NaN'::DOUBLE),
             coalesce(s.stage_1_weight, 'NaN'::DOUBLE)) AS term
  FROM lagged l LEFT JOIN stage_1 s
    ON l.store_id = s.store_id AND l.subcategory = s.subcategory AND l.gtin = s.gtin
   AND l.product_type IS NOT DISTINCT FROM s.product_type
   AND l.{period} IS NOT DISTINCT FROM s.period
),
type_product AS (
  SELECT store_id, subcategory, product_type, date, period,
         product(CASE WHEN term > 0 AND term < 'Infinity'::DOUBLE THEN term END) AS t
  FROM terms GROUP BY ALL
),
type_index AS (
  SELECT p.store_id, p.subcategory, p.product_type, p.date,
         CASE WHEN p.t > 0 AND p.t < 'Infinity'::DOUBLE THEN p.t END AS type_index,
         s.stage_2_weight
  FROM type_product p LEFT JOIN stage_2 s
    ON p.store_id = s.store_id AND p.subcategory = s.subcategory
   AND p.product_type IS NOT DISTINCT FROM s.product_type
   AND p.period IS NOT DISTINCT FROM s.period
)"""

STORE_INDEX = """
weighted AS (
  SELECT store_id, subcategory, date,
         pow(coalesce(type_index, 'NaN'::DOUBLE), coalesce(stage_2_weight, 'NaN'::DOUBLE)) AS w
  FROM type_index
),
store_product AS (
  SELECT store_id, date, product(CASE WHEN NOT isnan(w) THEN w END) AS i
  FROM weighted GROUP BY store_id, subcategory, date
),
store_index AS (
  SELECT store_id, date,
         CASE WHEN i > 0 AND i < 'Infinity'::DOUBLE THEN i END AS level,
         ln(CASE WHEN i > 0 AND i < 'Infinity'::DOUBLE THEN i END) AS log_level
  FROM store_product
)"""


def index_ctes(value: str, period: str, lines: bool = False) -> str:
    """WITH list that ends in ``store_index``."""
    order = ", l_orderkey, l_linenumber, l_partkey" if lines else ""
    parts = [
        LINES if lines else SCANNER,
        PREPARED,
        LAGGED.format(value=value, order=order),
        REVENUES.format(period=period),
        WEIGHTS,
        TYPE_INDEX.format(period=period),
        STORE_INDEX,
    ]
    return "WITH" + ",".join(parts)


STREETS = """
streets AS (
  SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN replace(p_name, 'e', 'é')
                         ELSE p_name END AS street
  FROM part
)"""

STORES_RAW = (
    STREETS
    + """,
stores_raw AS (
  SELECT s_suppkey AS store_id, s_name AS store_name,
         'Chain ' || s_nationkey AS store_chain_name,
         (s_suppkey % 90) || ' ' || ['North ', '', 'SE ', 'West '][s_suppkey % 4 + 1] || street || ' '
           || ['Street', 'Avenue', 'Ln', 'Boulevard', 'Drive', 'Highway'][s_suppkey % 6 + 1]
           || CASE WHEN s_suppkey % 3 = 0 THEN ', Suite ' || (s_suppkey % 9) ELSE '' END AS address,
         CASE WHEN s_suppkey % 17 <> 0
              THEN lpad(CAST(s_suppkey // 4 AS VARCHAR), 5, '0')
                   || CASE WHEN s_suppkey % 11 = 0 THEN '-1234' ELSE '' END END AS zip_code
  FROM supplier JOIN streets ON s_suppkey = p_partkey
)"""
)

STORES = (
    STORES_RAW
    + """,
stores AS (
  SELECT store_id, store_name, store_chain_name AS store_chain_name_pdi, address,
         zip_code
  FROM stores_raw
)"""
)

LETTERS_RAW = """
letters_raw AS (
  SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN 'Online' WHEN 1 THEN 'online' ELSE ' Retail ' END AS store_type,
         CAST(DATE '2000-01-01' + CAST(c_custkey % 700 AS INTEGER) AS DATE) AS insp_date,
         CASE WHEN c_custkey % 6 > 0
              THEN CAST(DATE '2000-01-01' + CAST(c_custkey % 700 + 60 AS INTEGER) AS DATE) END AS issue_date,
         c_name AS store_name,
         (near % 90 + c_custkey % 3) || ' ' || ['North ', '', 'S.E. ', 'W. '][c_custkey % 4 + 1] || street || '  '
           || ['St.', 'Ave', 'Lane', 'Blvd.', 'Dr.', 'Hwy'][near % 6 + 1]
           || CASE WHEN c_custkey % 10 = 3 THEN ' Suite 4' ELSE '' END AS address,
         'City ' || c_nationkey AS city, 'ST' AS state,
         CASE WHEN c_custkey % 23 = 0 THEN NULL
              WHEN c_custkey % 7 = 0 THEN '"' || lpad(CAST(c_custkey // 60 AS VARCHAR), 5, '0') || '"'
              ELSE lpad(CAST(c_custkey // 60 AS VARCHAR), 5, '0') END AS zip_code,
         c_mktsegment AS products
  FROM (SELECT *, c_custkey // 60 * 4 + c_custkey % 4 AS near FROM customer)
  JOIN streets ON near = p_partkey
)"""

LETTERS = (
    LETTERS_RAW
    + """,
letters AS (
  SELECT trim(store_type) AS store_type, insp_date, issue_date, store_name, trim(address) AS address,
         city, state, replace(zip_code, '"', '') AS zip_code, products
  FROM letters_raw WHERE trim(store_type) NOT IN ('Online', 'online')
)"""
)


def basic_clean_sql(text: str) -> str:
    """Accent fold, punctuation, whitespace."""
    folded = f"regexp_replace(strip_accents({text}), '[^\\x00-\\x7f]', '', 'g')"
    kept = f"regexp_replace({folded}, '[^A-Za-z0-9_,\\s\\x0b\\x1c-\\x1f]', '', 'g')"
    return f"trim(regexp_replace({kept}, '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))"


# The street-word rules, written out here a second time so that a rule
# lost from the library shows.
STREET_WORDS = [
    (r"\bStreet\b", "St"), (r"\bSt.\b", "St"), (r"\bAvenue\b", "Ave"), (r"\bAve.\b", "Ave"),
    (r"\bBoulevard\b", "Blvd"), (r"\bBlvd.\b", "Blvd"), (r"\bRoad\b", "Rd"), (r"\bRd.\b", "Rd"),
    (r"\bDrive\b", "Dr"), (r"\bDr.\b", "Dr"), (r"\bLn\b", "Lane"), (r"\bLn.\b", "Lane"),
    (r"\bPl\b", "Place"), (r"\bPl.\b", "Place"), (r"\bCt\b", "Court"), (r"\bCt.\b", "Court"),
    (r"\bHighway\b", "Hwy"), (r"\bsuite\b.*", ""), (r"\bSuite\b.*", ""), (r"\bste\b.*", ""),
    (r"\bSTE\b.*", ""), (r"\,", ""), (r"\bNortheast\b", "NE"), (r"\bNorthwest\b", "NW"),
    (r"\bSoutheast\b", "SE"), (r"\bSouthwest\b", "SW"), (r"\bNorth east\b", "NE"),
    (r"\bNorth west\b", "NW"), (r"\bSouth east\b", "SE"), (r"\bSouth west\b", "SW"),
    (r"\bNorth\b", "N"), (r"\bSouth\b", "S"), (r"\bEast\b", "E"), (r"\bWest\b", "W"),
    (r"\bN(?:\.)?\b", "N"), (r"\bS(?:\.)?\b", "S"), (r"\bE(?:\.)?\b", "E"), (r"\bW(?:\.)?\b", "W"),
    (r"\bNE(?:\.)?\b", "NE"), (r"\bNW(?:\.)?\b", "NW"), (r"\bSE(?:\.)?\b", "SE"),
    (r"\bSW(?:\.)?\b", "SW"), (r"\bN E(?:\.)?\b", "NE"), (r"\bN W(?:\.)?\b", "NW"),
    (r"\bS E(?:\.)?\b", "SE"), (r"\bS W(?:\.)?\b", "SW"),
]


def street_words_sql(text: str) -> str:
    for pattern, word in STREET_WORDS:
        text = f"regexp_replace({text}, '{pattern}', '{word}', 'gi')"
    return text


def token_sorted_sql(text: str) -> str:
    words = f"trim(regexp_replace(lower({text}), '[^a-z0-9_]+', ' ', 'g'))"
    return f"array_to_string(list_sort(string_split({words}, ' ')), ' ')"


def _longest_block(a: str, b: str) -> str:
    """Length k and negated start n of the longest block of ``a`` found in ``b``."""
    found = (
        f"[{{'k': k, 'n': -i}} for k in range(1, length({a}) - i + 2)"
        f" if contains({b}, substr({a}, i, k))]"
    )
    return f"list_max(flatten([{found} for i in range(1, length({a}) + 1)]))"


# Longest common block first, then the same on what lies left and right of it.
# The earliest block in the first text wins, then the earliest in the second.
BLOCK_RATIO = f"""
todo AS (
  SELECT DISTINCT words_a AS a, words_b AS b FROM pairs
  WHERE words_a <> words_b AND words_a <> '' AND words_b <> ''
),
search(top_a, top_b, a, b, hit) AS (
  SELECT a, b, a, b, {_longest_block("a", "b")} FROM todo
  UNION ALL
  SELECT top_a, top_b, x.a, x.b, {_longest_block("x.a", "x.b")}
  FROM (
    SELECT top_a, top_b, unnest([
      {{'a': substr(a, 1, -hit.n - 1),
        'b': substr(b, 1, strpos(b, substr(a, -hit.n, hit.k)) - 1)}},
      {{'a': substr(a, hit.k - hit.n),
        'b': substr(b, strpos(b, substr(a, -hit.n, hit.k)) + hit.k)}}
    ]) AS x
    FROM search WHERE hit IS NOT NULL
  ) WHERE x.a <> '' AND x.b <> ''
),
scored AS (
  SELECT top_a, top_b,
         CAST(round_even(100 * (2 * CAST(coalesce(sum(hit.k), 0) AS DOUBLE)
                                / CAST(length(top_a) + length(top_b) AS DOUBLE)), 0)
              AS INTEGER) AS score
  FROM search GROUP BY top_a, top_b
)"""
