"""The same queries as plain SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from tillscope.functions.calendar import MONTHS

STAR = """
WITH products AS (
    SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
           CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_size - 1 AS stock
    FROM part
), customers AS (
    SELECT c_custkey AS customer_id, c_name AS customer_name,
           CAST(CAST(10 + c_custkey % 41 AS DECIMAL(3,0)) * 0.1 AS DECIMAL(3,2)) AS rate
    FROM customer
), sales AS (
    SELECT l_orderkey AS sale_id, CAST(o_orderdate AS DATE) AS sale_date, o_custkey AS customer_id,
           l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), fact AS (
    SELECT s.*, p.product_name, p.category, p.price
    FROM sales s JOIN products p ON s.product_id = p.product_id
), fact_1997 AS (
    SELECT * FROM fact WHERE sale_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
), fact_1995 AS (
    SELECT * FROM fact WHERE sale_date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'
)
"""

REVENUE = "CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE)"
UNITS = "CAST(COALESCE(SUM(quantity), 0) AS BIGINT)"
MONTH_NO = "CAST(month(sale_date) AS BIGINT)"
MONTH_NAME = "strftime(sale_date, '%B')"
RUPEES = "'₹' || format('{{:,.{places}f}}', CAST({value} AS DOUBLE))"


def _rupees(value: str, places: int = 0) -> str:
    return RUPEES.format(value=value, places=places)


def _iso(day: str) -> str:
    return f"CAST(CAST({day} AS DATE) AS VARCHAR)"


def _mean(column: str) -> str:
    """Two places, half up, by whole hundredths; for columns without negative values."""
    total, count = f"CAST(SUM({column}) * 100 AS HUGEINT)", f"COUNT({column})"
    return (
        f"CASE WHEN {count} = 0 THEN 0.0 "
        f"ELSE CAST((2 * {total} + {count}) // (2 * {count}) AS DOUBLE) / 100 END"
    )


def _period_row(where: str) -> str:
    return f"""
        SELECT {REVENUE} AS revenue, COUNT(DISTINCT sale_id) AS orders,
               COUNT(DISTINCT customer_id) AS customers
        FROM fact WHERE {where}"""


def _between(low: str, high: str, category: str | None = None) -> str:
    dates = f"sale_date BETWEEN DATE '{low}' AND DATE '{high}'"
    return f"{dates} AND category = '{category}'" if category else dates


def _period_kpis(where: str) -> str:
    return f"""
    SELECT revenue, orders, customers AS active_customers,
           CASE WHEN orders > 0 THEN revenue / orders ELSE 0.0 END AS aov
    FROM ({_period_row(where)}
    )"""


def _comparison(current: str, prior: str) -> str:
    names = ("revenue", "orders", "customers", "aov")
    sides = []
    for side in ("c", "p"):
        prefix = {"c": "cur", "p": "prior"}[side]
        sides += [f"{side}.{n} AS {prefix}_{n}" for n in names]
    with_aov = "SELECT *, CASE WHEN orders > 0 THEN revenue / orders ELSE 0.0 END AS aov FROM"
    pcts, directions, labels = [], [], []
    for n in names:
        pcts.append(
            f"CASE WHEN prior_{n} <> 0 THEN (CAST(cur_{n} AS DOUBLE) - CAST(prior_{n} AS DOUBLE))"
            f" / CAST(prior_{n} AS DOUBLE) * 100 END AS {n}_pct"
        )
        directions.append(
            f"CASE WHEN {n}_pct > 0 THEN 'up' WHEN {n}_pct < 0 THEN 'down' ELSE 'neutral' END"
            f" AS {n}_direction"
        )
        shown = f"format('{{:.1f}}', abs({n}_pct)) || '% vs previous period'"
        labels.append(
            f"CASE WHEN {n}_pct IS NULL THEN 'No previous-period data available'"
            f" WHEN {n}_pct > 0 THEN '↑ ' || {shown} WHEN {n}_pct < 0 THEN '↓ ' || {shown}"
            f" ELSE {shown} END AS {n}_label"
        )
    return f"""
    SELECT *, {", ".join(directions)}, {", ".join(labels)}
    FROM (SELECT *, {", ".join(pcts)}
          FROM (SELECT {", ".join(sides)}
                FROM ({with_aov} ({_period_row(current)})) c
                CROSS JOIN ({with_aov} ({_period_row(prior)})) p))"""


def _trend(bucket: str, label: str, where: str) -> str:
    return f"""
    SELECT {_iso(bucket)} AS period_date, strftime({bucket}, '{label}') AS period_label,
           {REVENUE} AS revenue, COUNT(sale_id) AS orders
    FROM fact WHERE {where} GROUP BY ALL ORDER BY period_date"""


def _periods(number: str, label: str) -> str:
    return f"""
        SELECT {number} AS period_no, {label} AS period, {REVENUE} AS revenue
        FROM sales GROUP BY ALL"""


_MONTHS = _periods(MONTH_NO, MONTH_NAME)
_QUARTERS = _periods("CAST(quarter(sale_date) AS BIGINT)", "'Q' || quarter(sale_date)")
_YEARS = _periods("CAST(year(sale_date) AS BIGINT)", "CAST(year(sale_date) AS VARCHAR)")


def _summary(periods: str) -> str:
    return f"""
    SELECT (SELECT {REVENUE} FROM sales) AS total_revenue, COUNT(*) AS period_count,
           (SELECT {REVENUE} FROM sales) / COUNT(*) AS avg_revenue,
           (SELECT period FROM ({periods}) ORDER BY revenue DESC, period_no LIMIT 1) AS peak_period,
           MAX(revenue) AS peak_revenue
    FROM ({periods}
    )"""


def _share(periods: str) -> str:
    return f"""
    SELECT period_no, period, revenue,
           revenue / (SELECT {REVENUE} FROM sales) * 100 AS share_pct
    FROM ({periods}
    ) ORDER BY period_no"""


def _by_revenue(columns: str, extra: str = "", source: str = "fact", tail: str = "") -> str:
    measures = f"{REVENUE} AS revenue" + (f", {extra}" if extra else "")
    return f"""
    SELECT {columns}, {measures} FROM {source}
    GROUP BY {columns} ORDER BY revenue DESC, {columns} {tail}"""


def _by_units(where: str = "TRUE", tail: str = "LIMIT 10") -> str:
    return f"""
    SELECT product_name, {UNITS} AS units_sold FROM fact WHERE {where}
    GROUP BY product_name ORDER BY units_sold DESC, product_name {tail}"""


_BREAKDOWN = f"""
    SELECT *, revenue / (SELECT {REVENUE} FROM fact_1997) * 100 AS share_pct
    FROM (SELECT category, {REVENUE} AS revenue, {UNITS} AS units_sold, COUNT(sale_id) AS order_count
          FROM fact_1997 GROUP BY category)
    ORDER BY revenue DESC, category"""

_TOP_REVENUE = _by_revenue(
    "product_name, category", f"{UNITS} AS units_sold", "fact_1997", "LIMIT 5"
)

_TOP_CUSTOMERS_PERIOD = f"""
    SELECT customer_name, {REVENUE} AS total_spent, COUNT(sale_id) AS orders,
           CAST(rate AS DOUBLE) AS rating
    FROM fact_1997 JOIN customers USING (customer_id)
    GROUP BY customer_name, rate ORDER BY total_spent DESC, customer_name, rating LIMIT 5"""

_STATUS = """CASE WHEN stock = 0 THEN 'Out of Stock' WHEN stock <= 10 THEN 'Low Stock'
                  ELSE 'In Stock' END"""


def _inventory(where: str = "TRUE", target: int = 50) -> str:
    return f"""
        SELECT product_id, product_name, category, CAST(price AS DOUBLE) AS price,
               CAST(stock AS BIGINT) AS stock, {_STATUS} AS stock_status,
               CAST({target} AS BIGINT) AS target_stock,
               CAST(greatest(0, {target} - stock) AS BIGINT) AS suggested_reorder,
               CAST(greatest(0, {target} - stock) * price AS DOUBLE) AS est_reorder_cost
        FROM products WHERE {where}"""


def _catalog(where: str = "TRUE") -> str:
    return f"""
    SELECT *, CASE WHEN stock = 0 THEN '🔴 Out of Stock'
                   WHEN stock <= 10 THEN '🟡 Low (' || stock || ' left)'
                   ELSE '🟢 In Stock (' || stock || ' units)' END AS status_label
    FROM ({_inventory(where)}
    ) ORDER BY category, product_name, product_id"""


def _restock(where: str = "TRUE", target: int = 50) -> str:
    return f"""
    SELECT CASE WHEN stock = 0 THEN '🔴 Critical (Out of Stock)'
                ELSE '🟡 Urgent (Low Stock)' END AS urgency,
           CAST(CASE WHEN stock = 0 THEN 1 ELSE 2 END AS BIGINT) AS severity,
           * EXCLUDE (stock_status)
    FROM ({_inventory(where, target)}
    ) WHERE stock <= 10
    ORDER BY severity, stock, price DESC, category, product_name, product_id"""


_URGENT = """
    SELECT product_name, category, CAST(stock AS BIGINT) AS stock,
           CASE WHEN stock = 0 THEN 'Out of Stock' ELSE 'Low (' || stock || ' units)' END AS status
    FROM products WHERE stock <= 10 ORDER BY stock, product_name, category LIMIT 6"""

_PIVOT_MONTHS = ", ".join(
    f"CAST(SUM(CASE WHEN month(sale_date) = {number} THEN total_amount ELSE 0 END) AS DOUBLE) AS {name}"
    for number, name in enumerate(MONTHS, start=1)
)


def _dice(where: str) -> str:
    return f"""
    SELECT category, {MONTH_NAME} AS month, {REVENUE} AS revenue
    FROM fact WHERE {where} GROUP BY category, {MONTH_NAME}, {MONTH_NO} ORDER BY {MONTH_NO}, category"""


def _bands(where: str) -> str:
    return f"""
        SELECT COUNT(*) AS skus, COUNT(DISTINCT category) AS categories,
               COUNT(*) FILTER (stock > 10) AS in_stock,
               COUNT(*) FILTER (stock BETWEEN 1 AND 10) AS low_stock,
               COUNT(*) FILTER (stock = 0) AS out_of_stock,
               CAST(COALESCE(SUM(stock), 0) AS BIGINT) AS units_on_hand,
               CAST(COALESCE(SUM(suggested_reorder) FILTER (stock <= 10), 0) AS BIGINT)
                   AS reorder_units
        FROM ({_inventory(where)})"""


def _distribution(where: str) -> str:
    return f"""
    SELECT status, "count" FROM (
        SELECT 'In Stock' AS status, in_stock AS "count" FROM ({_bands(where)})
        UNION ALL SELECT 'Low Stock', low_stock FROM ({_bands(where)})
        UNION ALL SELECT 'Out of Stock', out_of_stock FROM ({_bands(where)})
    ) WHERE "count" > 0"""


_COMPARE_1995 = _comparison(
    _between("1995-01-01", "1995-12-31"), _between("1994-01-01", "1994-12-31")
)

_COMPARE_1997 = _comparison(
    _between("1997-01-01", "1997-12-31"), _between("1996-01-02", "1996-12-31")
)

_EXECUTIVE = f"""
    SELECT CAST(1 AS BIGINT) AS seq, 'category_leader' AS kind, category AS subject, revenue,
           share_pct AS pct, units_sold AS units, CAST(NULL AS BIGINT) AS orders,
           CAST(NULL AS BIGINT) AS customers, CAST(NULL AS DOUBLE) AS aov,
           CAST(NULL AS BIGINT) AS out_of_stock, CAST(NULL AS BIGINT) AS low_stock
    FROM (SELECT * FROM ({_BREAKDOWN}) LIMIT 1)
    UNION ALL
    SELECT 2, 'top_sku', product_name, revenue, NULL, units_sold, NULL, NULL, NULL, NULL, NULL
    FROM (SELECT * FROM ({_TOP_REVENUE}) LIMIT 1)
    UNION ALL
    SELECT 3, CASE WHEN o + l > 0 THEN 'replenishment' ELSE 'stock_optimal' END, NULL, NULL, NULL,
           o + l, NULL, NULL, NULL, o, l
    FROM (SELECT COUNT(*) FILTER (stock = 0) AS o, COUNT(*) FILTER (stock BETWEEN 1 AND 10) AS l
          FROM products)
    UNION ALL
    SELECT 4, CASE WHEN prior_orders > 0 THEN 'momentum' ELSE 'volume' END, NULL, cur_revenue,
           CASE WHEN prior_orders > 0 THEN revenue_pct END, NULL, cur_orders, cur_customers, cur_aov,
           NULL, NULL
    FROM ({_COMPARE_1997})"""


_EXECUTIVE_1995 = _EXECUTIVE.replace(_COMPARE_1997, _COMPARE_1995).replace("fact_1997", "fact_1995")


def _insights(source: str) -> str:
    counts = "units orders customers out_of_stock low_stock".split()
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in counts)
    return f"""
    SELECT * REPLACE ({doubles}) FROM ({source}) ORDER BY seq"""


def _texts(source: str) -> str:
    return f"""
    SELECT seq, kind, CASE kind
        WHEN 'category_leader' THEN subject || ' leads with ' || {_rupees('revenue')} || ', '
            || format('{{:.1f}}', pct) || '% of revenue'
        WHEN 'top_sku' THEN subject || ' sells most: ' || {_rupees('revenue')} || ' from '
            || format('{{:,}}', units) || ' units'
        WHEN 'replenishment' THEN format('{{:,}}', units) || ' products to restock: '
            || format('{{:,}}', out_of_stock) || ' sold out, ' || format('{{:,}}', low_stock) || ' low'
        WHEN 'stock_optimal' THEN 'No product needs restocking'
        WHEN 'momentum' THEN 'Revenue ' || CASE WHEN pct > 0 THEN '↑ ' WHEN pct < 0 THEN '↓ ' ELSE '' END
            || format('{{:.1f}}', abs(pct)) || '% vs previous period, average order ' || {_rupees('aov')}
        WHEN 'volume' THEN format('{{:,}}', orders) || ' orders by ' || format('{{:,}}', customers)
            || ' customers, average order ' || {_rupees('aov')}
        END AS text
    FROM ({source}) ORDER BY seq"""


def _nulls(table: str, columns: str) -> list[str]:
    return [
        f"SELECT 'null_{c}' AS \"check\", '{table}' AS table_name, COUNT(*) AS violations"
        f" FROM {table} WHERE {c} IS NULL"
        for c in columns.split()
    ]


def _check(name: str, table: str, source: str) -> str:
    return f"SELECT '{name}' AS \"check\", '{table}' AS table_name, COUNT(*) AS violations FROM {source}"


def _duplicates(table: str, key: str) -> str:
    groups = f"(SELECT {key} FROM {table} WHERE {key} IS NOT NULL GROUP BY {key} HAVING COUNT(*) > 1)"
    return _check("duplicate_key", table, groups)


_QUALITY = "\n    UNION ALL ".join(
    [
        *_nulls("products", "product_id product_name category price stock"),
        *_nulls("customers", "customer_id customer_name rate"),
        *_nulls("sales", "sale_id sale_date customer_id product_id quantity total_amount"),
        _duplicates("products", "product_id"),
        _duplicates("customers", "customer_id"),
        _duplicates("sales", "sale_id"),
        _check("negative_stock", "products", "products WHERE stock < 0"),
        _check("rate_out_of_range", "customers", "customers WHERE rate < 1 OR rate > 5"),
        _check("negative_amount", "sales", "sales WHERE total_amount < 0"),
        _check("quantity_not_positive", "sales", "sales WHERE quantity <= 0"),
        _check(
            "unknown_customer",
            "sales",
            "sales s LEFT JOIN customers c ON s.customer_id = c.customer_id WHERE c.customer_id IS NULL",
        ),
        _check(
            "unknown_product",
            "sales",
            "sales s LEFT JOIN products p ON s.product_id = p.product_id WHERE p.product_id IS NULL",
        ),
        _check("amount_not_quantity_x_price", "sales", "fact WHERE total_amount <> quantity * price"),
    ]
)

BODIES: dict[str, str] = {
    "total_kpis": f"""
    SELECT (SELECT {REVENUE} FROM sales) AS total_revenue, (SELECT COUNT(*) FROM sales) AS total_orders,
           (SELECT COUNT(*) FROM products) AS total_products,
           (SELECT COUNT(*) FROM customers) AS total_customers""",
    "filter_bounds": f"""
    SELECT {_iso('MIN(sale_date)')} AS min_date, {_iso('MAX(sale_date)')} AS max_date FROM sales""",
    "sale_years": "SELECT DISTINCT CAST(year(sale_date) AS BIGINT) AS yr FROM sales ORDER BY yr DESC",
    "categories": "SELECT DISTINCT category FROM products ORDER BY category",
    "sale_months": f"SELECT DISTINCT {MONTH_NAME} AS month, {MONTH_NO} AS month_no FROM sales ORDER BY month_no",
    "year_range": f"""
    SELECT CAST(yr AS BIGINT) AS yr,
           {_iso("greatest(make_date(yr, 1, 1), (SELECT MIN(sale_date) FROM sales))")} AS start_date,
           {_iso("least(make_date(yr, 12, 31), (SELECT MAX(sale_date) FROM sales))")} AS end_date
    FROM (SELECT DISTINCT year(sale_date) AS yr FROM sales) ORDER BY yr DESC""",
    "period_kpis_all": _period_kpis(_between("1997-01-01", "1997-12-31")),
    "period_kpis_category": _period_kpis(_between("1997-01-01", "1997-12-31", "SMALL")),
    "period_comparison": _COMPARE_1997,
    "period_comparison_category": _comparison(
        _between("1997-01-01", "1997-12-31", "SMALL"), _between("1996-01-02", "1996-12-31", "SMALL")
    ),
    "period_comparison_no_prior": _COMPARE_1995,
    "period_kpis_empty": _period_kpis(_between("1980-01-01", "1980-12-31")),
    "average_sale": f"SELECT {_mean('total_amount')} AS avg_order FROM sales",
    "trend_monthly": _trend(
        "date_trunc('month', sale_date)", "%b %Y", _between("1997-01-01", "1997-12-31")
    ),
    "trend_monthly_category": _trend(
        "date_trunc('month', sale_date)", "%b %Y", _between("1997-01-01", "1997-12-31", "SMALL")
    ),
    "trend_daily": _trend("sale_date", "%d %b", _between("1998-03-01", "1998-03-31")),
    "trend_70_days": _trend("sale_date", "%d %b", _between("1998-01-01", "1998-03-11")),
    "trend_71_days": _trend(
        "date_trunc('month', sale_date)", "%b %Y", _between("1998-01-01", "1998-03-12")
    ),
    "revenue_by_year": f"""
    SELECT CAST(year(sale_date) AS BIGINT) AS yr, {REVENUE} AS revenue FROM sales GROUP BY ALL ORDER BY yr""",
    "revenue_by_quarter": f"""
    SELECT period_no AS quarter_no, period, revenue FROM ({_QUARTERS}) ORDER BY quarter_no""",
    "revenue_by_month": f"""
    SELECT period_no AS month_no, period AS month, revenue FROM ({_MONTHS}) ORDER BY month_no""",
    "revenue_by_year_quarter": f"""
    SELECT CAST(year(sale_date) AS BIGINT) AS yr, 'Q' || quarter(sale_date) AS quarter,
           {REVENUE} AS revenue
    FROM sales GROUP BY ALL ORDER BY yr, quarter""",
    "period_summary": _summary(_MONTHS),
    "period_summary_year": _summary(_YEARS),
    "period_share": _share(_MONTHS),
    "period_share_quarter": _share(_QUARTERS),
    "date_coverage": f"""
    SELECT {_iso("MIN(sale_date)")} AS min_date, {_iso("MAX(sale_date)")} AS max_date,
           COUNT(DISTINCT month(sale_date)) AS distinct_months
    FROM sales""",
    "monthly_activity": f"""
    SELECT {MONTH_NO} AS month_no, {MONTH_NAME} AS month_name, COUNT(*) AS tx_count,
           {REVENUE} AS revenue
    FROM sales GROUP BY ALL ORDER BY month_no""",
    "category_revenue": _by_revenue("category"),
    "category_revenue_one": _by_revenue("category", source="fact WHERE category = 'SMALL'"),
    "category_breakdown": _BREAKDOWN,
    "category_coverage": _by_revenue(
        "category", f"COUNT(sale_id) AS sales_count, {UNITS} AS units_sold"
    ),
    "product_performance": _by_revenue("product_name, category", f"{UNITS} AS units_sold"),
    "product_performance_category": _by_revenue(
        "product_name, category", f"{UNITS} AS units_sold", "fact WHERE category = 'SMALL'"
    ),
    "units_by_product": _by_units(tail=""),
    "top_products_units": _by_units(),
    "top_products_units_category": _by_units("category = 'SMALL'"),
    "top_products_revenue": _TOP_REVENUE,
    "best_product": _by_units(tail="LIMIT 1"),
    "best_category": _by_revenue("category", tail="LIMIT 1"),
    "customer_kpis": f"""
    SELECT (SELECT COUNT(*) FROM customers) AS total_customers,
           (SELECT {_mean('rate')} FROM customers) AS avg_rating,
           (SELECT {_mean('total_amount')} FROM sales) AS avg_order,
           (SELECT COUNT(*) FROM (SELECT customer_id FROM sales GROUP BY customer_id
                                  HAVING COUNT(*) > 1)) AS repeat_customers""",
    "average_rating": f"SELECT {_mean('rate')} AS avg_rating FROM customers",
    "active_customer_rating": f"""
    SELECT {_mean('rate')} AS avg_rating FROM customers
    WHERE customer_id IN (SELECT customer_id FROM fact_1997 WHERE category = 'SMALL')""",
    "rating_distribution": """
    SELECT CAST(rate AS DOUBLE) AS rate, COUNT(*) AS total FROM customers GROUP BY ALL ORDER BY rate""",
    "top_customers": f"""
    SELECT customer_name, {REVENUE} AS total_spent
    FROM sales JOIN customers USING (customer_id)
    GROUP BY customer_name ORDER BY total_spent DESC, customer_name LIMIT 10""",
    "top_customers_period": _TOP_CUSTOMERS_PERIOD,
    "customer_summary": f"""
    SELECT customer_name, COUNT(sale_id) AS orders, {REVENUE} AS total_spent,
           {_mean('total_amount')} AS avg_purchase
    FROM customers c LEFT JOIN sales s ON c.customer_id = s.customer_id
    GROUP BY customer_name ORDER BY total_spent DESC, customer_name""",
    "recent_sales": f"""
    SELECT sale_id, {_iso("sale_date")} AS sale_date, CAST(total_amount AS DOUBLE) AS total_amount
    FROM sales ORDER BY sales.sale_date DESC, sale_id, sales.total_amount LIMIT 10""",
    "inventory_status": f"SELECT {_STATUS} AS status, COUNT(*) AS total FROM products GROUP BY ALL ORDER BY total DESC, status",
    "inventory_bands": f"""
    SELECT out_of_stock, low_stock, in_stock, skus AS total_products FROM ({_bands('TRUE')})""",
    "low_stock_count": "SELECT COUNT(*) AS low_stock FROM products WHERE stock <= 10",
    "low_stock": """
    SELECT product_id, product_name, category, CAST(stock AS BIGINT) AS stock
    FROM products WHERE stock <= 10 ORDER BY stock, product_name, product_id""",
    "urgent_stock": _URGENT,
    "stock_by_category": """
    SELECT category, CAST(COALESCE(SUM(stock), 0) AS BIGINT) AS stock FROM products GROUP BY category
    ORDER BY category""",
    "inventory_by_category": """
    SELECT category, CAST(SUM(stock) AS BIGINT) AS total_stock, COUNT(product_id) AS sku_count
    FROM products WHERE contains(lower(product_name), 'gear') GROUP BY category
    ORDER BY total_stock DESC, category""",
    "inventory_catalog": _catalog(),
    "inventory_search": _catalog("regexp_matches(lower(product_name), 'gear|^red') AND stock <= 10"),
    "inventory_out": _catalog("stock = 0"),
    "inventory_low": _catalog("stock BETWEEN 1 AND 10"),
    "inventory_in": _catalog("stock > 10"),
    "inventory_kpis": _bands("category = 'SMALL'"),
    "stock_distribution": _distribution("category = 'SMALL'"),
    "stock_distribution_low": _distribution("stock BETWEEN 1 AND 10"),
    "restock_plan": _restock(),
    "restock_plan_target": _restock("category = 'SMALL'", 100),
    "restock_totals": """
    SELECT COUNT(*) AS skus, CAST(COALESCE(SUM(greatest(0, 50 - stock)), 0) AS BIGINT) AS units,
           CAST(COALESCE(SUM(greatest(0, 50 - stock) * price), 0) AS DOUBLE) AS cost
    FROM products WHERE stock <= 10""",
    "olap_rollup": f"""
    SELECT CAST(year(sale_date) AS BIGINT) AS yr, {REVENUE} AS revenue FROM sales GROUP BY ALL ORDER BY yr""",
    "olap_drilldown": f"""
    SELECT {MONTH_NAME} AS month, {MONTH_NO} AS month_no, {REVENUE} AS revenue
    FROM sales GROUP BY ALL ORDER BY month_no""",
    "olap_calendar_rollup": f"""
    SELECT level, period, revenue, order_count FROM (
        SELECT 1 AS place, 'total' AS level, 'all' AS period, {REVENUE} AS revenue, COUNT(*) AS order_count FROM sales
        UNION ALL
        SELECT 2, 'year', CAST(year(sale_date) AS VARCHAR), {REVENUE}, COUNT(*) FROM sales GROUP BY ALL
        UNION ALL
        SELECT 3, 'quarter', year(sale_date) || ' Q' || quarter(sale_date), {REVENUE}, COUNT(*) FROM sales GROUP BY ALL
        UNION ALL
        SELECT 4, 'month', strftime(sale_date, '%Y-%m'), {REVENUE}, COUNT(*) FROM sales GROUP BY ALL
    ) ORDER BY place, period""",
    "olap_slice_all": _by_revenue("category"),
    "olap_slice_category": _by_revenue("product_name", source="fact WHERE category = 'SMALL'"),
    "olap_dice": _dice(f"category = 'SMALL' AND {MONTH_NAME} = 'March'"),
    "olap_dice_all": _dice("TRUE"),
    "olap_dice_month": _dice(f"{MONTH_NAME} = 'March'"),
    "olap_dice_category": _dice("category = 'SMALL'"),
    "olap_pivot": f"SELECT category, {_PIVOT_MONTHS} FROM fact GROUP BY category ORDER BY category",
    "executive_insights": _insights(_EXECUTIVE),
    "executive_insights_no_prior": _insights(_EXECUTIVE_1995),
    "executive_insight_texts": _texts(_EXECUTIVE),
    "executive_insight_texts_no_prior": _texts(_EXECUTIVE_1995),
    "olap_insights": f"""
    SELECT COALESCE((SELECT product_name FROM ({_by_units(tail='LIMIT 1')})), 'N/A') AS best_product,
           COALESCE((SELECT category FROM ({_by_revenue('category', tail='LIMIT 1')})), 'N/A')
               AS best_category,
           (SELECT {_mean('total_amount')} FROM sales) AS avg_order,
           (SELECT COUNT(*) FROM products WHERE stock <= 10) AS low_stock""",
    "row_counts": """
    SELECT 'products' AS table_name, COUNT(*) AS row_count FROM products
    UNION ALL SELECT 'customers', COUNT(*) FROM customers
    UNION ALL SELECT 'sales', COUNT(*) FROM sales""",
    "quality_report": f"SELECT * FROM (\n    {_QUALITY}\n    ) ORDER BY table_name, \"check\"",
    "gated_write": f"SELECT * FROM (\n    {_QUALITY}\n    ) ORDER BY table_name, \"check\"",
    "category_view": f"""
    SELECT category AS "Category", {_rupees('revenue')} AS "Revenue",
           format('{{:.1f}}', share_pct) || '%' AS "% of Total"
    FROM ({_BREAKDOWN})""",
    "top_products_view": f"""
    SELECT product_name AS "Product", category AS "Category", {_rupees('revenue')} AS "Revenue",
           format('{{:,}}', units_sold) AS "Units Sold"
    FROM ({_TOP_REVENUE})""",
    "top_customers_view": f"""
    SELECT customer_name AS "Customer Name", {_rupees('total_spent')} AS "Total Spent",
           orders AS "Orders", '⭐ ' || format('{{:.1f}}', rating) AS "Rating"
    FROM ({_TOP_CUSTOMERS_PERIOD})""",
    "urgent_stock_view": f"""
    SELECT product_name AS "Product", category AS "Category", stock AS "Stock Left", status AS "Status"
    FROM ({_URGENT})""",
    "period_view": f"""
    SELECT period AS "Month", {_rupees('revenue', 2)} AS "Revenue (₹)",
           format('{{:.1f}}', share_pct) || '%' AS "% of Total Revenue"
    FROM ({_share(_MONTHS)})""",
    "restock_view": f"""
    SELECT urgency AS "Priority Urgency", product_name AS "Product Name", category AS "Category",
           stock AS "Current Stock", target_stock AS "Target Stock",
           suggested_reorder AS "Suggested Reorder Qty", {_rupees('price', 2)} AS "Unit Price",
           {_rupees('est_reorder_cost', 2)} AS "Est. Restock Cost"
    FROM ({_restock()})""",
    "catalog_view": f"""
    SELECT product_id AS "Product ID", product_name AS "Product Name", category AS "Category",
           {_rupees('price', 2)} AS "Unit Price (₹)", stock AS "Current Stock",
           status_label AS "Status", target_stock AS "Target Level",
           suggested_reorder AS "Suggested Reorder",
           {_rupees('est_reorder_cost', 2)} AS "Est. Restock Cost (₹)"
    FROM ({_catalog()})""",
    "inventory_report": f"""
    SELECT product_id AS "Product ID", product_name AS "Product Name", category AS "Category",
           price AS "Unit Price (INR)", stock AS "Current Stock", stock_status AS "Stock Status",
           target_stock AS "Target Stock Level", suggested_reorder AS "Suggested Reorder Qty",
           est_reorder_cost AS "Estimated Restock Cost (INR)"
    FROM ({_catalog()})""",
    "sales_report": f"""
    SELECT sale_id, {_iso("sale_date")} AS sale_date, customer_id, product_id, CAST(quantity AS BIGINT) AS quantity,
           CAST(total_amount AS DOUBLE) AS total_amount
    FROM sales
    ORDER BY sales.sale_date DESC, sale_id, product_id, customer_id, sales.quantity, sales.total_amount
    LIMIT 10""",
}

# The same results from a star that is stored for its joins.
BODIES |= {f"colocated_{name}": BODIES[name] for name in ("product_performance", "customer_summary")}
# And from stored sums by day and product.
DAILY = ("total_kpis", "trend_monthly_category", "category_breakdown", "olap_calendar_rollup", "olap_dice")
BODIES |= {f"daily_{name}": BODIES[name] for name in DAILY}

ORACLES = {name: STAR + body for name, body in BODIES.items()}
