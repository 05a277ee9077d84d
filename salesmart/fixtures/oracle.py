"""The fixture queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

RAW_COLS = (
    "order_id, customer_id, product, category, quantity, unit_price, "
    "sales, profit, date, region, discount_pct"
)

_RAW = """
raw AS (
    SELECT l_orderkey AS order_id,
           CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE o_custkey END AS customer_id,
           CASE WHEN l_partkey % 103 = 0 THEN NULL ELSE p_name END AS product,
           p_type AS category,
           CASE WHEN l_suppkey % 37 = 0 THEN -l_quantity ELSE l_quantity END AS quantity,
           l_extendedprice / l_quantity AS unit_price,
           CASE WHEN l_suppkey % 41 = 7 THEN NULL
                ELSE l_extendedprice * (1 - l_discount)
                     * CASE WHEN l_orderkey % 211 = 0 THEN 50 ELSE 1 END END AS sales,
           l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS profit,
           CASE WHEN l_orderkey % 307 = 0 THEN NULL WHEN l_partkey % 113 = 0 THEN '2024-02-30'
                ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
           r_name AS region,
           l_discount * 250 AS discount_pct,
           l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey
)"""

_STEPS = f"""{_RAW},
deduped AS (
    SELECT * FROM raw
    QUALIFY row_number() OVER (
        PARTITION BY order_id
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate
    ) = 1
),
complete AS (
    SELECT * FROM deduped
    WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND product IS NOT NULL
      AND category IS NOT NULL AND quantity IS NOT NULL AND unit_price IS NOT NULL
      AND sales IS NOT NULL AND profit IS NOT NULL AND date IS NOT NULL AND region IS NOT NULL
),
positive AS (SELECT * FROM complete WHERE NOT (sales <= 0 OR quantity <= 0 OR unit_price <= 0)),
known_category AS (
    SELECT * FROM positive
    WHERE category IN ('ECONOMY', 'SMALL', 'LARGE', 'MEDIUM', 'STANDARD')
),
known_region AS (
    SELECT * FROM known_category WHERE region IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')
),
clean AS (
    SELECT order_id, customer_id, product, category, quantity, unit_price, sales, profit,
           try_cast(date AS DATE) AS date, region, discount_pct
    FROM known_region
    WHERE try_cast(date AS DATE) IS NOT NULL
)"""

_SALES = f"""{_STEPS},
derived AS (
    SELECT *,
           CAST(year(date) AS INTEGER) AS year,
           CAST(month(date) AS INTEGER) AS month,
           CAST(quarter(date) AS INTEGER) AS quarter,
           strftime(date, '%b') AS month_name,
           strftime(date, '%A') AS day_of_week,
           strftime(date, '%Y-%m') AS year_month,
           round_even(profit / sales * 100 * 100, 0) / 100 AS profit_margin_pct,
           round_even(sales / quantity * 100, 0) / 100 AS revenue_per_unit,
           count(order_id) OVER (PARTITION BY customer_id) AS customer_orders,
           CASE WHEN discount_pct <= -1 THEN NULL WHEN discount_pct <= 0 THEN 'No Discount'
                WHEN discount_pct <= 10 THEN '1-10%' WHEN discount_pct <= 20 THEN '11-20%'
                WHEN discount_pct <= 100 THEN '20%+' END AS discount_band
    FROM clean
),
stats AS (SELECT avg(sales) + 3 * stddev_samp(sales) AS upper_limit FROM clean),
sales AS (
    SELECT derived.*,
           CASE WHEN profit_margin_pct <= 0 THEN 'Loss' WHEN profit_margin_pct <= 15 THEN 'Low'
                WHEN profit_margin_pct <= 30 THEN 'Medium' ELSE 'High' END AS profit_tier,
           CASE WHEN customer_orders <= 3 THEN 'One-time'
                WHEN customer_orders <= 7 THEN 'Returning' ELSE 'Loyal' END AS customer_segment,
           coalesce(CAST(sales > (SELECT upper_limit FROM stats) AS INTEGER), 0) AS is_outlier
    FROM derived
)"""

_MONEY = (
    "CASE WHEN {x} >= 1e7 THEN 'Rs ' || format('{{:.1f}}', {x} / 1e7) || 'Cr' "
    "WHEN {x} >= 1e5 THEN 'Rs ' || format('{{:.1f}}', {x} / 1e5) || 'L' "
    "ELSE 'Rs ' || format('{{:,.0f}}', {x}) END"
)


def _money(x: str) -> str:
    return _MONEY.format(x=x)


def _percent(x: str) -> str:
    return f"format('{{:.1f}}', {x}) || '%'"


def _sum(x: str, kind: str = "DECIMAL(28,4)") -> str:
    return f"coalesce(CAST(sum(CAST({x} AS {kind})) AS DOUBLE), 0)"


_AVG_MARGIN = (
    "CAST(sum(CAST(profit_margin_pct AS DECIMAL(28,2))) AS DOUBLE) / count(profit_margin_pct)"
)


def _raw(select: str) -> str:
    return f"WITH {_RAW} {select}"


def _steps(select: str) -> str:
    return f"WITH {_STEPS} {select}"


def _sales(select: str) -> str:
    return f"WITH {_SALES} {select}"


_FILTERED = "order_id, customer_id, product, category, region, date, sales, profit"


def _filtered(where: str) -> str:
    return _sales(f"SELECT {_FILTERED} FROM sales WHERE {where}")


def _kpis(where: str) -> str:
    return f"""kpis AS (
        SELECT *, CASE WHEN orders = 0 THEN 0 ELSE total_sales / orders END AS avg_order_value
        FROM (
            SELECT {_sum("sales")} AS total_sales, {_sum("profit")} AS total_profit,
                   CASE WHEN count(*) > 0 THEN {_AVG_MARGIN} END AS avg_margin,
                   count(*) AS orders, count(DISTINCT customer_id) AS customers,
                   CAST(coalesce(sum(is_outlier), 0) AS BIGINT) AS outliers
            FROM sales WHERE {where}
        )
    )"""


_AUDIT = f"""audit AS (
    SELECT count(*) AS orders, {_sum("sales")} AS total_sales, {_sum("profit")} AS total_profit,
           {_AVG_MARGIN} AS avg_margin, count(DISTINCT customer_id) AS customers,
           min(date) AS date_min, max(date) AS date_max,
           CAST(sum(is_outlier) AS BIGINT) AS outliers, count(DISTINCT category) AS categories
    FROM sales
)"""

_MONTHS = f"""months AS (
    SELECT year_month, sum(CAST(sales AS DECIMAL(28,4))) AS exact_sales,
           {_sum("sales")} AS sales, {_sum("profit")} AS profit
    FROM sales GROUP BY year_month
)"""

_GROWTH = f"""{_MONTHS},
growth AS (
    SELECT * FROM (
        SELECT year_month, sales,
               CASE WHEN before <> 0 THEN (sales / before - 1) * 100
                    WHEN before = 0 AND sales > 0 THEN CAST('inf' AS DOUBLE)
                    WHEN before = 0 AND sales < 0 THEN CAST('-inf' AS DOUBLE) END AS mom
        FROM (SELECT year_month, sales, lag(sales) OVER (ORDER BY year_month) AS before FROM months)
    ) WHERE mom IS NOT NULL
)"""

_TOP = f"""top AS (
    SELECT product, sales, CAST(row_number() OVER (ORDER BY sales, product) AS INTEGER) AS pos
    FROM (
        SELECT product, {_sum("sales")} AS sales FROM sales
        GROUP BY product ORDER BY sales DESC, product LIMIT 10
    )
)"""

_TIERS = """tiers AS (
    SELECT profit_tier, count(order_id) AS orders,
           CASE profit_tier WHEN 'Loss' THEN 1 WHEN 'Low' THEN 2
                            WHEN 'Medium' THEN 3 WHEN 'High' THEN 4 ELSE 5 END AS tier_rank
    FROM sales GROUP BY profit_tier
)"""

_BANDS = f"""bands AS (
    SELECT discount_band, {_AVG_MARGIN} AS avg_margin, count(order_id) AS orders,
           CASE discount_band WHEN 'No Discount' THEN 1 WHEN '1-10%' THEN 2
                              WHEN '11-20%' THEN 3 WHEN '20%+' THEN 4 ELSE 5 END AS band_rank
    FROM sales WHERE discount_band IS NOT NULL GROUP BY discount_band
)"""

_RECENT = """recent AS (
    SELECT *, CAST(row_number() OVER (ORDER BY date DESC, order_id) AS INTEGER) AS pos
    FROM (
        SELECT order_id, customer_id, product, category, sales, profit, profit_margin_pct,
               region, date, profit_tier, customer_segment
        FROM sales ORDER BY date DESC, order_id LIMIT 20
    )
)"""

_OPTIONS = "\nUNION ALL ".join(
    f"SELECT {n} AS filter_pos, 0 AS pos, '{name}' AS filter, '{first}' AS label, 'all' AS value "
    f"UNION ALL SELECT {n}, CAST(row_number() OVER (ORDER BY value) AS INTEGER), '{name}', "
    f"{label}, value "
    f"FROM (SELECT DISTINCT CAST({name} AS VARCHAR) AS value FROM sales WHERE {name} IS NOT NULL)"
    for n, (name, first, label) in enumerate(
        (
            ("year", "All Years", "value"),
            ("quarter", "All Quarters", "'Q' || value"),
            ("category", "All Categories", "value"),
            ("product", "All Products", "value"),
            ("region", "All Regions", "value"),
        ),
        start=1,
    )
)

_TEXT_IDS = (
    "CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id, "
    "product, category, quantity, unit_price, sales, profit"
)

ORACLE_SQL = {
    # sources and sinks
    "src_csv_scan": _raw(
        f"SELECT {_TEXT_IDS}, try_cast(date AS DATE) AS date, region, discount_pct FROM raw"
    ),
    "src_table_scan": _sales(f"SELECT {RAW_COLS}, year, year_month FROM sales"),
    "src_fallback": _raw(f"""
        SELECT {_TEXT_IDS}, region, discount_pct, date,
               CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
               CAST(quarter(date) AS INTEGER) AS quarter, strftime(date, '%b') AS month_name,
               round_even(profit / sales * 100 * 100, 0) / 100 AS profit_margin_pct,
               strftime(date, '%Y-%m') AS year_month,
               coalesce(CAST(sales > (SELECT avg(sales) + 3 * stddev_samp(sales) FROM raw)
                             AS INTEGER), 0) AS is_outlier,
               'Medium' AS profit_tier, 'Returning' AS customer_segment
        FROM (SELECT * REPLACE (try_cast(date AS DATE) AS date) FROM raw)"""),
    "sink_table_replace": _sales(
        f"SELECT {RAW_COLS}, year, quarter, year_month, profit_margin_pct FROM sales"
    ),
    "sink_row_count": _steps(
        "SELECT count(*) AS rows_written, count(*) AS rows_read_back FROM clean"
    ),
    # data quality
    "dq_dedup_first": _steps(f"SELECT {RAW_COLS} FROM deduped"),
    "dq_null_profile": _steps("""
        SELECT column_name, missing FROM (
            SELECT count(*) FILTER (order_id IS NULL) AS order_id,
                   count(*) FILTER (customer_id IS NULL) AS customer_id,
                   count(*) FILTER (product IS NULL) AS product,
                   count(*) FILTER (category IS NULL) AS category,
                   count(*) FILTER (quantity IS NULL) AS quantity,
                   count(*) FILTER (unit_price IS NULL) AS unit_price,
                   count(*) FILTER (sales IS NULL) AS sales,
                   count(*) FILTER (profit IS NULL) AS profit,
                   count(*) FILTER (date IS NULL) AS date,
                   count(*) FILTER (region IS NULL) AS region
            FROM deduped
        ) UNPIVOT (missing FOR column_name IN (
            order_id, customer_id, product, category, quantity,
            unit_price, sales, profit, date, region))
        WHERE missing > 0"""),
    "dq_drop_nulls": _steps(f"SELECT {RAW_COLS} FROM complete"),
    "dq_positive_numeric": _steps(f"SELECT {RAW_COLS} FROM positive"),
    "dq_category_domain": _steps(f"SELECT {RAW_COLS} FROM known_category"),
    "dq_region_domain": _steps(f"SELECT {RAW_COLS} FROM known_region"),
    "dq_date_parse": _steps("""
        SELECT order_id, date AS date_text, try_cast(date AS DATE) AS date,
               try_cast(date AS DATE) IS NULL AS is_bad
        FROM known_region"""),
    "dq_issue_report": _steps("""
        SELECT seq, rule, n, message FROM (
            SELECT 1 AS seq, 'duplicate_order_id' AS rule, n,
                   'Dropped ' || n || ' duplicate order_ids' AS message
            FROM (SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM deduped) AS n)
            UNION ALL
            SELECT 2, 'missing_value', n, 'Nulls found: {' || concat_ws(', ',
                CASE WHEN c > 0 THEN '''customer_id'': ' || c END,
                CASE WHEN p > 0 THEN '''product'': ' || p END,
                CASE WHEN s > 0 THEN '''sales'': ' || s END,
                CASE WHEN f > 0 THEN '''profit'': ' || f END,
                CASE WHEN d > 0 THEN '''date'': ' || d END) || '}'
            FROM (SELECT (SELECT count(*) FROM deduped) - (SELECT count(*) FROM complete) AS n,
                         count(*) FILTER (customer_id IS NULL) AS c,
                         count(*) FILTER (product IS NULL) AS p,
                         count(*) FILTER (sales IS NULL) AS s,
                         count(*) FILTER (profit IS NULL) AS f,
                         count(*) FILTER (date IS NULL) AS d
                  FROM deduped)
            UNION ALL
            SELECT 3, 'non_positive', n, 'Dropped ' || n || ' rows with invalid numeric values'
            FROM (SELECT (SELECT count(*) FROM complete) - (SELECT count(*) FROM positive) AS n)
            UNION ALL
            SELECT 4, 'unknown_category', n, 'Dropped ' || n || ' unknown categories'
            FROM (SELECT (SELECT count(*) FROM positive)
                       - (SELECT count(*) FROM known_category) AS n)
            UNION ALL
            SELECT 5, 'unknown_region', n, 'Dropped ' || n || ' unknown regions'
            FROM (SELECT count(*) AS n FROM positive
                  WHERE region NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE'))
            UNION ALL
            SELECT 6, 'bad_date', n, 'Dropped ' || n || ' bad dates'
            FROM (SELECT (SELECT count(*) FROM known_region) - (SELECT count(*) FROM clean) AS n)
        ) WHERE n > 0"""),
    "dq_row_totals": _steps("""
        SELECT r AS rows_in, r - c AS rows_dropped, c AS rows_clean
        FROM (SELECT (SELECT count(*) FROM raw) AS r, (SELECT count(*) FROM clean) AS c)"""),
    "dq_validate": _steps(f"SELECT {RAW_COLS} FROM clean"),
    # enrichment
    "tx_date_parts": _sales("""
        SELECT order_id, year, month, quarter, month_name, day_of_week, year_month,
               strftime(date, '%Y-%m-%d') AS date_text
        FROM sales"""),
    "tx_ratios": _sales("SELECT order_id, profit_margin_pct, revenue_per_unit FROM sales"),
    "tx_profit_tier": _sales("SELECT order_id, profit_margin_pct, profit_tier FROM sales"),
    "tx_customer_orders": _sales("SELECT order_id, customer_id, customer_orders FROM sales"),
    "tx_customer_segment": _sales("SELECT order_id, customer_id, customer_segment FROM sales"),
    "tx_sales_stats": """
        SELECT round(avg(value), 4) AS mean_value, round(stddev_samp(value), 4) AS sd_value
        FROM events""",
    "tx_outlier_flag": """
        SELECT event_id, value,
               coalesce(CAST(value > (SELECT avg(value) + 3 * stddev_samp(value) FROM events)
                             AS INTEGER), 0) AS is_outlier
        FROM events""",
    "tx_enrich": _sales(f"""
        SELECT {RAW_COLS}, year, month, quarter, month_name, day_of_week, profit_margin_pct,
               revenue_per_unit, profit_tier, customer_segment, is_outlier, year_month
        FROM sales"""),
    # audit
    "audit_summary": f"WITH {_SALES}, {_AUDIT} SELECT * FROM audit",
    "audit_formatted": f"""WITH {_SALES}, {_AUDIT}
        SELECT format('{{:,}}', orders) AS total_orders,
               'INR ' || format('{{:,.0f}}', total_sales) AS total_sales,
               'INR ' || format('{{:,.0f}}', total_profit) AS total_profit,
               {_percent("avg_margin")} AS avg_margin,
               format('{{:,}}', customers) AS unique_customers,
               CAST(date_min AS VARCHAR) || ' to ' || CAST(date_max AS VARCHAR) AS date_range,
               CAST(outliers AS VARCHAR) AS outlier_rows,
               CAST(categories AS VARCHAR) AS categories
        FROM audit""",
    # dimensions
    "dim_years": _sales("SELECT DISTINCT year FROM sales ORDER BY year"),
    "dim_categories": _sales("SELECT DISTINCT category FROM sales ORDER BY category"),
    "dim_regions": _sales("SELECT DISTINCT region FROM sales ORDER BY region"),
    "dim_products": _sales("SELECT DISTINCT product FROM sales ORDER BY product"),
    "dim_quarters": _sales("SELECT DISTINCT quarter FROM sales ORDER BY quarter"),
    "dim_date_bounds": _sales("SELECT min(date) AS date_min, max(date) AS date_max FROM sales"),
    "dim_filter_options": _sales(_OPTIONS),
    # filters
    "flt_year": _filtered("year = 1997"),
    "flt_quarter": _filtered("quarter = 2"),
    "flt_category": _filtered("category = 'SMALL'"),
    "flt_product": _filtered("product = 'red widget'"),
    "flt_region": _filtered("region = 'ASIA'"),
    "flt_date_range": _filtered("date BETWEEN DATE '1996-02-15' AND DATE '1997-06-30'"),
    "flt_combined": _filtered(
        "year = 1997 AND quarter = 2 AND category = 'SMALL' AND region = 'ASIA' "
        "AND date BETWEEN DATE '1997-04-10' AND DATE '1997-06-20'"
    ),
    "flt_empty": f"WITH {_SALES}, {_kpis("category = 'NONE SUCH'")} SELECT * FROM kpis",
    # headline figures
    "kpi_summary": f"WITH {_SALES}, {_kpis('true')} SELECT * FROM kpis",
    "kpi_cards": f"""WITH {_SALES}, {_kpis("true")}
        SELECT 1 AS seq, 'Total Revenue' AS title, {_money("total_sales")} AS value,
               format('{{:,}}', orders) || ' orders' AS sub FROM kpis
        UNION ALL SELECT 2, 'Total Profit', {_money("total_profit")},
               {_percent("avg_margin")} || ' margin' FROM kpis
        UNION ALL SELECT 3, 'Avg Order Value', {_money("avg_order_value")},
               'per transaction' FROM kpis
        UNION ALL SELECT 4, 'Unique Customers', format('{{:,}}', customers),
               'active buyers' FROM kpis
        UNION ALL SELECT 5, 'Outlier Orders', format('{{:,}}', outliers),
               'high-val spikes' FROM kpis""",
    # metrics
    "m_monthly_trend": f"WITH {_SALES}, {_MONTHS} SELECT year_month, sales, profit FROM months",
    "m_category_sales": _sales(
        f"SELECT category, {_sum('sales')} AS sales FROM sales GROUP BY category"
    ),
    "m_category_share": _sales(f"""
        SELECT category, CAST(s AS DOUBLE) AS sales,
               CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE) * 100 AS share_pct
        FROM (SELECT category, sum(CAST(sales AS DECIMAL(28,4))) AS s
              FROM sales GROUP BY category)"""),
    "m_rolling_3m": f"""WITH {_SALES}, {_MONTHS}
        SELECT year_month, sales,
               CAST(sum(exact_sales) OVER w AS DOUBLE) / count(*) OVER w AS r3m
        FROM months
        WINDOW w AS (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "m_mom_growth": f"WITH {_SALES}, {_GROWTH} SELECT year_month, sales, mom FROM growth",
    "m_mom_growth_label": f"""WITH {_SALES}, {_GROWTH}
        SELECT year_month, round_even(mom * 10, 0) / 10 AS mom_shown,
               format('{{:.1f}}', round_even(mom * 10, 0) / 10) || '%' AS mom_text,
               CASE WHEN mom >= 0 THEN 'up' ELSE 'down' END AS direction
        FROM growth""",
    "m_region_perf": _sales(f"""
        SELECT *, CAST(row_number() OVER (ORDER BY sales, region) AS INTEGER) AS pos
        FROM (SELECT region, {_sum("sales")} AS sales, {_sum("profit")} AS profit
              FROM sales GROUP BY region)"""),
    "m_top_products": f"WITH {_SALES}, {_TOP} SELECT * FROM top",
    "m_top_products_label": f"""WITH {_SALES}, {_TOP}
        SELECT *, {_money("sales")} AS sales_text FROM top""",
    "m_profit_tier": f"WITH {_SALES}, {_TIERS} SELECT * FROM tiers",
    "m_profit_tier_label": f"""WITH {_SALES}, {_TIERS}
        SELECT *, CAST(orders AS VARCHAR) || ' orders' AS orders_text FROM tiers""",
    "m_segment": _sales(f"""
        SELECT customer_segment, count(DISTINCT customer_id) AS customers,
               {_sum("sales")} AS revenue,
               CASE customer_segment WHEN 'One-time' THEN 1 WHEN 'Returning' THEN 2
                                     WHEN 'Loyal' THEN 3 ELSE 4 END AS segment_rank
        FROM sales GROUP BY customer_segment"""),
    "m_discount_band": _sales("SELECT order_id, discount_pct, discount_band FROM sales"),
    "m_discount_impact": f"WITH {_SALES}, {_BANDS} SELECT * FROM bands",
    "m_discount_label": f"""WITH {_SALES}, {_BANDS}
        SELECT discount_band, band_rank, round_even(avg_margin * 10, 0) / 10 AS margin_shown,
               format('{{:.1f}}', round_even(avg_margin * 10, 0) / 10) || '%' AS margin_text
        FROM bands""",
    "m_recent_orders": f"WITH {_SALES}, {_RECENT} SELECT * FROM recent",
    "m_recent_formatted": f"""WITH {_SALES}, {_RECENT}
        SELECT * REPLACE ({_money("sales")} AS sales, {_money("profit")} AS profit,
                          {_percent("profit_margin_pct")} AS profit_margin_pct,
                          strftime(date, '%d %b %Y') AS date)
        FROM recent""",
    # display
    "fx_money": _sales(f"""
        SELECT order_id, {_money("sales")} AS sales_text, {_money("profit")} AS profit_text,
               {_money("(sales * 1000)")} AS thousandfold_text
        FROM sales"""),
    "fx_percent": _sales(
        f"SELECT order_id, {_percent('profit_margin_pct')} AS margin_text FROM sales"
    ),
    "fx_title_columns": _sales("""
        SELECT order_id AS "Order Id", profit_margin_pct AS "Profit Margin Pct",
               profit_tier AS "Profit Tier", year_month AS "Year Month"
        FROM sales"""),
    # the load run and the dashboard as they are used
    "tx_load_stamp": _steps("""
        SELECT order_id, 19 AS stamp_length, true AS is_stamp, true AS is_now FROM clean"""),
}
_ENRICHED = (
    f"{RAW_COLS}, year, month, quarter, month_name, day_of_week, profit_margin_pct, "
    "revenue_per_unit, profit_tier, customer_segment, is_outlier, year_month"
)
_IN_1997 = _SALES.replace("\nsales AS (", "\nall_sales AS (") + (
    ", sales AS (SELECT * FROM all_sales WHERE year = 1997)"
)
ORACLE_SQL |= {
    "etl_run": _sales(f"SELECT {_ENRICHED} FROM sales"),
    "etl_report": ORACLE_SQL["dq_issue_report"],
    "dash_monthly": f"WITH {_IN_1997}, {_MONTHS} SELECT year_month, sales, profit FROM months",
    "dash_category": ORACLE_SQL["m_category_share"].replace(f"WITH {_SALES}", f"WITH {_IN_1997}"),
    "dash_kpis": ORACLE_SQL["kpi_cards"].replace(f"WITH {_SALES}", f"WITH {_IN_1997}"),
    "dash_discount": ORACLE_SQL["m_discount_label"].replace(f"WITH {_SALES}", f"WITH {_IN_1997}"),
    "src_csv_feed": _sales(f"SELECT {_ENRICHED} FROM sales"),
    "flt_product_clustered": _filtered("product = 'hot rod'"),
    "kpi_sketch": f"""WITH {_SALES}, {_kpis("true")}
        SELECT * EXCLUDE (customers), true AS customers_within_error FROM kpis""",
    "dash_region_cube": ORACLE_SQL["m_region_perf"].replace(
        f"WITH {_SALES}",
        "WITH " + _SALES.replace("\nsales AS (", "\nall_sales AS (")
        + ", sales AS (SELECT * FROM all_sales WHERE quarter = 2 AND category = 'SMALL')",
    ),
}
