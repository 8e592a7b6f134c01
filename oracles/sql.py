"""DuckDB SQL for the registered queries, written apart from the engine.

Each oracle is one statement over the given tables: the common table expressions it needs,
then its own SELECT. Rounding goes through the shortest decimal text of a double, half away
from zero.
"""

from __future__ import annotations

import re


def rnd(value: str, digits: int) -> str:
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,20)), {digits}) AS DOUBLE)"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def product(k: str) -> dict[str, str]:
    """SQL of the product attributes of a part key."""
    n = f"({k} // 20)"
    turn = f"({n} // 6)"
    sub = (
        f"CASE {n} % 6 WHEN 0 THEN ['Midi','Maxi','Mini'][1 + {turn} % 3]"
        f" WHEN 1 THEN ['Shirt','Blouse','T-Shirt'][1 + {turn} % 3]"
        f" WHEN 2 THEN ['Chino','Denim','Formal'][1 + {turn} % 3]"
        f" WHEN 3 THEN ['Jacket','Coat'][1 + {turn} % 2]"
        f" WHEN 4 THEN ['Sneaker','Heel','Sandal'][1 + {turn} % 3]"
        f" ELSE ['Bag','Belt','Scarf'][1 + {turn} % 3] END"
    )
    retail = f"CAST(2000 + ({n} * 37) % 41 * 100 AS DOUBLE)"
    return {
        "sku": f"CAST({k} AS VARCHAR)",
        "style_id": f"printf('STY%04d', {n} + 1)",
        "style_name": f"{sub} || ' ' || ['Classic','Relaxed','Tailored','Everyday'][1 + {n} % 4]",
        "category": f"['Dresses','Tops','Trousers','Outerwear','Footwear','Accessories'][1 + {n} % 6]",
        "subcategory": sub,
        "colour": f"['Black','Ivory','Navy','Olive'][1 + ({k} % 20) // 5]",
        "size": f"CASE {n} % 6 WHEN 5 THEN 'OS' WHEN 4 THEN CAST(38 + {k} % 5 AS VARCHAR)"
        f" ELSE ['XS','S','M','L','XL'][1 + {k} % 5] END",
        "season": f"CASE WHEN {n} % 2 = 0 THEN 'SS26' ELSE 'AW25' END",
        "cost_price": f"{retail} * 2 / 5",
        "retail_price": retail,
        "launch_date": f"DATE '2026-06-01' + CAST(({n} * 7) % 88 AS INTEGER)",
    }


def columns(attributes: dict[str, str]) -> str:
    return ",\n  ".join(f"{sql} AS {name}" for name, sql in attributes.items())


TXN = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
DAY = "(DATE '2026-08-01' + CAST((CAST(l_shipdate AS DATE) - DATE '1995-01-01') % 28 AS INTEGER))"
QTY = (
    "CASE WHEN l_orderkey % 601 = 0 THEN NULL WHEN l_orderkey % 211 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END"
)
P = product("p_partkey")
L = product("l_partkey")
SIZE_RANK = (
    "CASE size WHEN 'OS' THEN 0 WHEN 'XS' THEN 1 WHEN 'S' THEN 2 WHEN 'M' THEN 3 WHEN 'L' THEN 4 WHEN 'XL' THEN 5"
    " ELSE coalesce(TRY_CAST(size AS INTEGER), 99) END"
)
SOLD_AT = (
    f"{DAY} + to_hours(CAST(9 + l_linenumber % 13 AS INTEGER)) + to_minutes(CAST(l_orderkey % 60 AS INTEGER))"
)


def share(value: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN {value} / {total} * 100 ELSE 0.0 END"


CTES: dict[str, str] = {
    "products": f"SELECT {columns(P)} FROM part WHERE (p_partkey // 20) % 6 <> 5 OR p_partkey % 5 = 0",
    "stores": """SELECT CAST(s_suppkey AS VARCHAR) AS store_id, s_name AS store_name, n_name AS city, r_name AS region,
        CASE WHEN s_suppkey % 6 = 5 THEN 'online' ELSE 'retail' END AS channel
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "raw_sales": f"""SELECT {TXN} AS transaction_id, CAST(l_partkey AS VARCHAR) AS sku,
        CAST(l_suppkey AS VARCHAR) AS store_id, {SOLD_AT} AS sold_at, {QTY} AS quantity,
        CASE WHEN l_orderkey % 307 = 0 THEN {L['retail_price']} * 11 / 10
             ELSE {rnd(f"{L['retail_price']} * (1 - l_discount)", 0)} END AS unit_price,
        {L['retail_price']} AS list_price,
        CASE WHEN l_orderkey % 401 = 0 THEN 0.95 ELSE l_discount END::DOUBLE AS discount_pct,
        'CUST' || (l_orderkey % 9000) AS customer_id,
        CASE WHEN l_orderkey % 503 = 0 THEN '{{"legacy":"1"}}' END AS _rescued_data, {DAY} AS sale_date,
        l_orderkey FROM lineitem""",
    "checked_sales": f"""SELECT r.*, {rnd('list_price * quantity', 2)} AS gross_amount,
        {rnd('unit_price * quantity', 2)} AS net_amount,
        {rnd('list_price * quantity - unit_price * quantity', 2)} AS discount_amount,
        concat_ws(',',
          CASE WHEN _rescued_data IS NOT NULL THEN 'no_rescued_fields' END,
          CASE WHEN r.sku NOT IN (SELECT sku FROM products) THEN 'known_sku' END,
          CASE WHEN quantity <= 0 THEN 'positive_quantity' END,
          CASE WHEN unit_price <= 0 THEN 'positive_price' END,
          CASE WHEN unit_price > list_price * 1.001::DOUBLE THEN 'price_not_above_list' END,
          CASE WHEN discount_pct < 0 OR discount_pct > 0.9::DOUBLE THEN 'discount_within_bounds' END) AS violations
        FROM raw_sales r""",
    "good_sales": "SELECT * FROM checked_sales WHERE violations = ''",
    "raw_returns": f"""SELECT 'R-' || {TXN} AS return_id,
        CASE WHEN l_partkey % 97 = 0 THEN 'X-' ELSE '' END || {TXN} AS transaction_id,
        CAST(l_partkey AS VARCHAR) AS sku,
        {DAY} + CAST(CASE WHEN l_partkey % 113 = 0 THEN -1 ELSE 2 + l_partkey % 11 END AS INTEGER) AS returned_at,
        {QTY} AS quantity, ['size','fit','quality','changed_mind','damaged'][1 + l_linenumber % 5] AS reason,
        CASE WHEN l_orderkey % 509 = 0 THEN '{{"legacy":"1"}}' END AS _rescued_data
        FROM lineitem WHERE l_returnflag = 'R'""",
    "first_sales": "SELECT transaction_id, MIN(sale_date) AS sale_date FROM good_sales GROUP BY 1",
    "checked_returns": """SELECT r.*, r.returned_at - s.sale_date AS days_to_return,
        concat_ws(',',
          CASE WHEN r._rescued_data IS NOT NULL THEN 'no_rescued_fields' END,
          CASE WHEN s.transaction_id IS NULL THEN 'matched_to_sale' END,
          CASE WHEN r.quantity <= 0 THEN 'positive_quantity' END,
          CASE WHEN r.returned_at < s.sale_date THEN 'returned_after_sale' END) AS violations
        FROM raw_returns r LEFT JOIN first_sales s ON r.transaction_id = s.transaction_id""",
    "good_returns": "SELECT * FROM checked_returns WHERE violations = ''",
    "lines_held": """SELECT DISTINCT l_partkey, l_suppkey, (l_partkey * 13 + l_suppkey * 7) % 61 AS b FROM lineitem""",
    "raw_inventory": """SELECT d.day AS snapshot_date, CAST(l_partkey AS VARCHAR) AS sku,
        CAST(l_suppkey AS VARCHAR) AS store_id, d.extra + CASE WHEN (l_partkey + l_suppkey) % 127 = 0 THEN -1
          WHEN l_partkey % 5 = 0 THEN 3 * b WHEN l_partkey % 5 = 2 THEN b // 4 ELSE b END AS on_hand,
        b % 3 * 10 AS on_order
        FROM lines_held, (VALUES (DATE '2026-08-28', 0), (DATE '2026-08-27', 1)) AS d(day, extra)""",
    "checked_inventory": """SELECT *, concat_ws(',',
          CASE WHEN sku NOT IN (SELECT sku FROM products) THEN 'known_sku' END,
          CASE WHEN on_hand < 0 THEN 'non_negative_on_hand' END,
          CASE WHEN on_order < 0 THEN 'non_negative_on_order' END) AS violations FROM raw_inventory""",
    "good_inventory": "SELECT * FROM checked_inventory WHERE violations = ''",
    "came_back": "SELECT transaction_id, SUM(quantity) AS units FROM good_returns GROUP BY 1",
    "net": f"""SELECT s.*, coalesce(c.units, 0) AS returned_quantity, s.quantity - coalesce(c.units, 0) AS kept_quantity,
        {rnd('s.unit_price * coalesce(c.units, 0)', 2)} AS returned_amount,
        {rnd('s.net_amount - s.unit_price * coalesce(c.units, 0)', 2)} AS net_revenue
        FROM good_sales s LEFT JOIN came_back c USING (transaction_id)""",
    "sold": """SELECT n.*, p.style_id, p.style_name, p.category, p.subcategory, p.season, p.size, p.cost_price, st.channel
        FROM net n JOIN products p USING (sku) JOIN stores st USING (store_id)""",
    "day_totals": f"""SELECT sale_date, category, channel, {big('SUM(quantity)')} AS units_sold,
        {big('SUM(kept_quantity)')} AS units_kept, {rnd('SUM(gross_amount)', 2)} AS gross_amount,
        {rnd('SUM(discount_amount)', 2)} AS discount_amount, {rnd('SUM(net_revenue)', 2)} AS net_revenue,
        {rnd('SUM(cost_price * kept_quantity)', 2)} AS cost_of_goods,
        COUNT(DISTINCT transaction_id) AS transactions FROM sold GROUP BY 1, 2, 3""",
    "daily": f"""SELECT *, {rnd('net_revenue - cost_of_goods', 2)} AS margin_amount,
        {rnd(share(rnd('net_revenue - cost_of_goods', 2), 'net_revenue'), 1)} AS margin_pct,
        {rnd(share('discount_amount', 'gross_amount'), 1)} AS discount_pct FROM day_totals""",
    "style_returns": """SELECT style_id, SUM(quantity) AS returned_units FROM good_returns JOIN products USING (sku)
        GROUP BY 1""",
    "style_totals": f"""SELECT style_id, style_name, category, subcategory, season, {big('SUM(quantity)')} AS units_sold,
        {rnd('SUM(net_revenue)', 2)} AS net_revenue, {rnd('SUM(cost_price * kept_quantity)', 2)} AS cost_of_goods,
        {rnd('CAST(CAST(SUM(CAST(CAST(discount_pct AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE) / COUNT(discount_pct) * 100', 1)}
          AS avg_discount_pct, COUNT(DISTINCT sku) AS sku_count FROM sold GROUP BY 1, 2, 3, 4, 5""",
    "styles_ranked": f"""SELECT t.*, {big('coalesce(returned_units, 0)')} AS returned_units,
        {rnd('net_revenue - cost_of_goods', 2)} AS margin_amount,
        {rnd(share('coalesce(returned_units, 0)', 'units_sold'), 1)} AS return_rate_pct,
        row_number() OVER (ORDER BY net_revenue DESC, style_id) AS revenue_rank
        FROM style_totals t LEFT JOIN style_returns USING (style_id)""",
    "newest_stock": """SELECT * FROM good_inventory
        WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM good_inventory)""",
    "rates": """SELECT sku, store_id, SUM(quantity) / 14.0::DOUBLE AS daily_sell_rate FROM good_sales
        WHERE sale_date >= (SELECT MAX(snapshot_date) FROM good_inventory) - 14 GROUP BY 1, 2""",
    "stock_lines": f"""SELECT i.snapshot_date, sku, style_id, style_name, category, colour, size, store_id, store_name, city,
        on_hand, on_order, coalesce(daily_sell_rate, 0.0::DOUBLE) AS rate, retail_price,
        CASE WHEN coalesce(daily_sell_rate, 0) > 0 THEN {rnd('on_hand / daily_sell_rate', 1)} END AS days_of_cover
        FROM newest_stock i LEFT JOIN rates USING (sku, store_id) JOIN products USING (sku)
        JOIN stores USING (store_id)""",
    "health": f"""SELECT snapshot_date, sku, style_id, style_name, category, colour, size, store_id, store_name, city,
        on_hand, on_order, {rnd('rate', 2)} AS daily_sell_rate, days_of_cover,
        CASE WHEN on_hand = 0 THEN 'stockout' WHEN rate <= 0 THEN 'dead' WHEN days_of_cover < 7 THEN 'critical'
             WHEN days_of_cover < 21 THEN 'low' WHEN days_of_cover > 90 THEN 'overstock' ELSE 'healthy' END AS status,
        {rnd('on_hand * retail_price', 2)} AS stock_value FROM stock_lines""",
    "reasons": f"""SELECT category, reason, {big('SUM(quantity)')} AS returned_units,
        {rnd('AVG(days_to_return)', 1)} AS avg_days_to_return FROM good_returns JOIN products USING (sku) GROUP BY 1, 2""",
    "analysis": f"""SELECT r.category, reason, returned_units, avg_days_to_return, c.units_sold,
        {rnd('returned_units / c.units_sold * 100', 2)} AS return_rate_pct
        FROM reasons r JOIN (SELECT category, {big('SUM(quantity)')} AS units_sold FROM sold GROUP BY 1) c
        ON r.category = c.category""",
    "demand": f"""SELECT style_id, style_name, category, size, {big('SUM(quantity)')} AS units_sold FROM sold
        WHERE size <> 'OS' GROUP BY 1, 2, 3, 4""",
    "held": """SELECT style_id, size, SUM(on_hand) AS on_hand FROM newest_stock JOIN products USING (sku) GROUP BY 1, 2""",
    "curve_rows": f"""SELECT d.*, {big('coalesce(h.on_hand, 0)')} AS on_hand,
        SUM(units_sold) OVER (PARTITION BY style_id) AS style_units,
        SUM(coalesce(h.on_hand, 0)) OVER (PARTITION BY style_id) AS style_stock
        FROM demand d LEFT JOIN held h USING (style_id, size)""",
    "curve_shares": f"""SELECT style_id, size, style_name, category, units_sold, on_hand,
        {rnd('units_sold / style_units * 100', 1)} AS demand_share,
        {rnd(share('on_hand', 'style_stock'), 1)} AS stock_share FROM curve_rows""",
    "curve": f"""SELECT *, {rnd('stock_share - demand_share', 1)} AS imbalance,
        CASE WHEN {rnd('stock_share - demand_share', 1)} < -10 THEN 'under-stocked'
             WHEN {rnd('stock_share - demand_share', 1)} > 10 THEN 'over-stocked' ELSE 'balanced' END AS signal
        FROM curve_shares""",
    "markdowns": """SELECT style_id,
        CAST(CAST(SUM(CAST(CAST(discount_pct AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE) / COUNT(discount_pct) AS markdown
        FROM good_sales JOIN products USING (sku)
        WHERE sale_date >= (SELECT MAX(sale_date) FROM good_sales) - 7 GROUP BY 1""",
    "catalog": f"""SELECT p.sku, p.style_id || '-' || upper(p.colour[1:3]) AS product_id, p.style_id, p.style_name,
        p.category, p.subcategory, p.colour, p.size, p.season, {rnd('p.retail_price', 0)} AS list_price,
        {rnd('p.retail_price * (1 - coalesce(m.markdown, 0.0::DOUBLE))', 0)} AS current_price,
        {rnd('coalesce(m.markdown, 0.0::DOUBLE) * 100', 0)} AS discount_pct,
        {big('coalesce(k.on_hand, 0)')} AS on_hand, {big('coalesce(d.units, 0)')} AS units_sold,
        {rnd(share('coalesce(r.units, 0)', 'coalesce(d.units, 0)'), 1)} AS return_rate_pct, p.launch_date
        FROM products p LEFT JOIN markdowns m ON p.style_id = m.style_id
        LEFT JOIN (SELECT sku, SUM(quantity) AS units FROM good_sales GROUP BY 1) d ON p.sku = d.sku
        LEFT JOIN (SELECT sku, SUM(quantity) AS units FROM good_returns GROUP BY 1) r ON p.sku = r.sku
        LEFT JOIN (SELECT sku, SUM(on_hand) AS on_hand FROM newest_stock GROUP BY 1) k ON p.sku = k.sku""",
    "ways": f"""SELECT product_id, style_id, style_name, category, subcategory, colour, season,
        MAX(list_price) AS list_price, MAX(current_price) AS current_price, MAX(discount_pct) AS discount_pct,
        {big('SUM(on_hand)')} AS on_hand, {big('SUM(units_sold)')} AS units_sold,
        {rnd('CAST(SUM(CAST(round(return_rate_pct * 10) AS BIGINT)) AS DOUBLE) / 10 / COUNT(*)', 1)} AS return_rate_pct,
        MAX(launch_date) AS launch_date,
        coalesce(string_agg(CASE WHEN on_hand > 0 THEN size END, ',' ORDER BY {SIZE_RANK}, size), '') AS sizes_in_stock,
        string_agg(size, ',' ORDER BY {SIZE_RANK}, size) AS sizes_all,
        SUM(on_hand) > 0 AS in_stock,
        (SELECT MAX(sale_date) FROM good_sales) - MAX(launch_date) <= 30 AS is_new
        FROM catalog GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "styles": """SELECT *, row_number() OVER (ORDER BY units_sold DESC, product_id) AS popularity_rank FROM ways""",
    "usage": """SELECT CAST(l_shipdate AS DATE) AS usage_date, l_shipdate AS usage_start_time,
        CASE WHEN l_suppkey % 2 = 0 THEN 'AZURE' ELSE 'GCP' END AS cloud, p_brand AS sku_name,
        l_quantity AS usage_quantity, ['JOBS','ALL_PURPOSE','SQL'][1 + l_linenumber % 3] AS billing_origin_product,
        CASE WHEN l_suppkey % 4 <> 0 THEN 'job-' || (l_suppkey % 40) END AS job_id, 'run-' || l_orderkey AS job_run_id,
        'cl-' || l_suppkey AS cluster_id, p_type AS purpose,
        CASE WHEN l_partkey % 3 <> 0 THEN 'team-' || (l_partkey % 4) END AS owner
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "prices": """SELECT cloud, p_brand AS sku_name, DATE '1995-01-01' + step * 800 AS price_start,
        CASE WHEN step < 2 THEN DATE '1995-01-01' + (step + 1) * 800 END AS price_end,
        (10 + CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 7 + step * 3
          + CASE WHEN cloud = 'GCP' THEN 1 ELSE 0 END) / 4.0::DOUBLE AS price
        FROM (SELECT DISTINCT p_brand FROM part), (VALUES ('AZURE'), ('GCP')) AS c(cloud),
          (VALUES (0), (1), (2)) AS s(step)""",
    "priced": """SELECT u.*, u.usage_quantity * p.price AS usd FROM usage u JOIN prices p
        ON u.cloud = p.cloud AND u.sku_name = p.sku_name AND u.usage_start_time >= p.price_start
        AND (p.price_end IS NULL OR u.usage_start_time < p.price_end)""",
    "clusters": """SELECT 'cl-' || s_suppkey AS cluster_id, 'cluster ' || s_suppkey || ' v' || v AS cluster_name,
        CASE WHEN (s_suppkey + v) % 2 = 0 THEN 'JOB' ELSE 'UI' END AS cluster_source, v
        FROM supplier JOIN (VALUES (1), (2), (3)) AS t(v) ON v <= 1 + s_suppkey % 3""",
    "newest_clusters": """SELECT cluster_id, cluster_name, cluster_source FROM clusters
        QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY v DESC) = 1""",
    "line_sums": f"""SELECT l_orderkey, {big('SUM(CAST(l_quantity AS BIGINT))')} AS units,
        SUM({rnd(rnd(L['retail_price'] + ' * (1 - l_discount)', 0) + ' * CAST(l_quantity AS BIGINT)', 2)}) AS amount
        FROM lineitem GROUP BY 1""",
    "book": """SELECT 'ORD-' || o_orderkey AS order_id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS placed_at,
        coalesce(c_name, 'Customer ' || o_custkey) AS customer_name, 'C' || o_custkey || '@Example.com' AS customer_email,
        'City ' || (o_custkey % 25) AS city, coalesce(units, 0) AS item_count, coalesce(amount, 0::DOUBLE) AS subtotal,
        coalesce(amount, 0::DOUBLE) + CASE WHEN coalesce(amount, 0) >= 2999 THEN 0 ELSE 149 END AS total,
        CASE o_orderstatus WHEN 'F' THEN 'delivered'
          WHEN 'P' THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'cancelled' ELSE 'placed' END
          ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'shipped'
            WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'packed' ELSE 'placed' END END AS status,
        o_orderkey, o_custkey, o_orderdate FROM orders LEFT JOIN customer ON c_custkey = o_custkey
        LEFT JOIN line_sums ON l_orderkey = o_orderkey""",
    "changes": """SELECT order_id, 1 AS seq, 'packed' AS status,
          CASE WHEN o_orderkey % 3 = 0 THEN 'first ' || o_orderkey END AS note,
          o_orderdate + to_hours(CAST(o_orderkey % 5 + 1 AS INTEGER)) AS updated_at FROM book WHERE o_orderkey % 17 <> 0
        UNION ALL
        SELECT order_id, 2, CASE WHEN o_orderkey % 13 = 0 THEN 'lost' WHEN o_orderkey % 11 = 0 THEN 'cancelled'
          ELSE 'shipped' END, CASE WHEN o_orderkey % 6 = 1 THEN 'second ' || o_orderkey END,
          o_orderdate + to_hours(CAST(o_orderkey % 7 + 1 AS INTEGER)) FROM book WHERE o_orderkey % 17 <> 0""",
    "known_changes": """SELECT * FROM changes
        WHERE status IN ('placed', 'packed', 'shipped', 'delivered', 'cancelled')""",
    "last_change": """SELECT * FROM known_changes
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, seq DESC) = 1""",
    "last_note": """SELECT order_id, note FROM known_changes WHERE note IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, seq DESC) = 1""",
    "current": """SELECT b.* EXCLUDE (status), coalesce(c.status, b.status) AS status,
        coalesce(c.updated_at, b.placed_at) AS updated_at, n.note FROM book b LEFT JOIN last_change c USING (order_id) LEFT JOIN last_note n USING (order_id)""",
    "moves": """SELECT c.*, list_reduce(list_prepend(b.status, coalesce(earlier, [])), lambda x, y: CASE WHEN
          x = 'placed' AND y IN ('packed', 'cancelled') OR x = 'packed' AND y IN ('shipped', 'cancelled')
          OR x = 'shipped' AND y = 'delivered' THEN y ELSE x END) AS met
        FROM (SELECT *, list(status) OVER (PARTITION BY order_id ORDER BY updated_at, seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM changes) c JOIN book b USING (order_id)""",
    "judged": """SELECT *, met = 'placed' AND status IN ('packed', 'cancelled')
          OR met = 'packed' AND status IN ('shipped', 'cancelled') OR met = 'shipped' AND status = 'delivered' AS legal
        FROM moves""",
    "taken": """SELECT order_id, last(status ORDER BY updated_at, seq) AS status, max(updated_at) AS updated_at,
          last(note ORDER BY updated_at, seq) FILTER (note IS NOT NULL) AS note FROM judged WHERE legal GROUP BY 1""",
    "unwanted_days": """SELECT *, day(sale_date) % 7 = 0 AND channel = 'online' OR sale_date = DATE '2026-08-10' AS gone
        FROM daily""",
    "late_days": """SELECT DISTINCT sale_date FROM good_sales JOIN good_returns r USING (transaction_id)
        WHERE sale_date <= DATE '2026-08-03'""",
    "book_lines": "SELECT 'ORD-' || l_orderkey AS order_id, l_linenumber AS line_no, CAST(l_partkey AS VARCHAR) AS sku, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem",
    "reserved": f"""SELECT sku, {big('SUM(quantity)')} AS reserved FROM book_lines JOIN current USING (order_id)
        WHERE status <> 'cancelled' GROUP BY 1""",
    "available": f"""SELECT sku, product_id, list_price, current_price,
        {big('greatest(0, on_hand - coalesce(reserved, 0))')} AS available
        FROM catalog LEFT JOIN reserved USING (sku)""",
    "bag": f"""SELECT l_orderkey AS bag_id, CAST(l_partkey AS VARCHAR) AS sku,
        least(10, greatest(1, {big('SUM(l_quantity)')})) AS quantity FROM lineitem GROUP BY 1, 2""",
    "bag_totals": """SELECT bag_id, COUNT(available) AS lines,
        coalesce(SUM(CASE WHEN available IS NOT NULL THEN quantity END), 0) AS items,
        coalesce(SUM(current_price * quantity), 0.0) AS subtotal,
        coalesce(SUM((list_price - current_price) * quantity), 0.0) AS saved,
        coalesce(bool_or(quantity > available), false) AS short
        FROM bag LEFT JOIN available USING (sku) GROUP BY 1""",
    "drops": f"""SELECT *, l_orderkey % 503 = 0 AS broken, l_orderkey % 211 = 0 AS mistyped,
        strftime(sale_date, '%Y-%m-%d') AS dt,
        CASE WHEN l_orderkey % 401 = 0 THEN 'P' || (l_orderkey % 7) END AS promo FROM raw_sales""",
}


def oracle(body: str) -> str:
    """``body`` behind the expressions it refers to, directly or not."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"[a-z_]+", pending.pop()))
        for name in CTES:
            if name in words and name not in needed:
                needed.add(name)
                pending.append(CTES[name])
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items() if name in needed)
    return f"WITH {listed}\n{body}" if listed else body


def text(column: str) -> str:
    return f"CAST({column} AS VARCHAR) AS {column}"


def moment(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


SALE = f"""transaction_id, sku, store_id, {moment('sold_at')}, quantity, unit_price, list_price, discount_pct,
    customer_id, _rescued_data, {text('sale_date')}, gross_amount, net_amount, discount_amount"""
DAILY = f"""{text('sale_date')}, category, channel, units_sold, units_kept, gross_amount, discount_amount, net_revenue,
    cost_of_goods, transactions, margin_amount, margin_pct, discount_pct"""
RETURN = f"""transaction_id, return_id, sku, {text('returned_at')}, quantity, reason, _rescued_data, days_to_return"""
STOCK = f"""sku, {text('snapshot_date')}, store_id, {big('on_hand')} AS on_hand, on_order,
    CAST(NULL AS VARCHAR) AS _rescued_data"""
STYLE = f"""product_id, style_id, style_name, category, subcategory, colour, season, list_price, current_price,
    discount_pct, on_hand, units_sold, return_rate_pct, {text('launch_date')}, sizes_in_stock, sizes_all, in_stock, is_new,
    popularity_rank"""
WAY = STYLE.rsplit(",", 1)[0]
LAST_DAYS = "sale_date >= (SELECT MAX(sale_date) FROM daily) - 14"
REVENUE = f"{rnd('SUM(net_revenue)', 0)} AS net_revenue"
MARGIN = f"{rnd('SUM(margin_amount) / nullif(SUM(net_revenue), 0) * 100', 1)} AS margin_pct"
SPEND = f"{rnd('SUM(usage_quantity)', 3)} AS dbus, {rnd('SUM(usd)', 4)} AS usd"
SPEND_BY_DAY = f"""SELECT {text('usage_date')}, sku_name, {rnd('SUM(usd) * 88', 2)} AS inr_approx, {SPEND}
    FROM priced GROUP BY usage_date, sku_name"""
VIOLATIONS = """SELECT rule, COUNT(*) AS failing
    FROM (SELECT unnest(string_split(violations, ',')) AS rule FROM {0} WHERE violations <> '') GROUP BY 1"""
INVENTORY_LINE = """sku, style_name, category, colour, size, store_name, city, on_hand, on_order, daily_sell_rate,
    days_of_cover, status, stock_value"""
ORDER_LINE = f"""order_id, {moment('placed_at')}, {moment('updated_at')}, customer_name,
    city, item_count, total, status"""


def grouped(number: str) -> str:
    """Indian digit grouping of a non-negative whole number."""
    digits = f"CAST({number} AS VARCHAR)"
    head = f"left({digits}, length({digits}) - 3)"
    even = f"(CASE WHEN length({head}) % 2 = 1 THEN ' ' ELSE '' END || {head})"
    return (
        f"CASE WHEN length({digits}) <= 3 THEN {digits} ELSE "
        rf"ltrim(regexp_replace({even}, '(..)', '\1,', 'g')) || right({digits}, 3) END"
    )


def half_even(number: str, unit: int) -> str:
    """A whole number in units, ties to the even unit."""
    rest = f"({number} % {unit})"
    up = f"({rest} * 2 > {unit} OR ({rest} * 2 = {unit} AND ({number} // {unit}) % 2 = 1))"
    return f"({number} // {unit} + CASE WHEN {up} THEN 1 ELSE 0 END)"


WHOLE = "CAST(net_revenue AS BIGINT)"
COMPACT = (
    f"CASE WHEN {WHOLE} >= 10000000 THEN printf('₹%d.%02dCr', {half_even(WHOLE, 100000)} // 100, {half_even(WHOLE, 100000)} % 100)"
    f" WHEN {WHOLE} >= 100000 THEN printf('₹%d.%dL', {half_even(WHOLE, 10000)} // 10, {half_even(WHOLE, 10000)} % 10)"
    f" WHEN {WHOLE} >= 1000 THEN printf('₹%d.%dk', {half_even(WHOLE, 100)} // 10, {half_even(WHOLE, 100)} % 10)"
    f" ELSE '₹' || {grouped(WHOLE)} END"
)

BODIES: dict[str, str] = {
    "silver_sales_good": f"SELECT {SALE} FROM good_sales",
    "silver_sales_quarantine": f"SELECT {SALE}, violations AS _violations FROM checked_sales WHERE violations <> ''",
    "silver_returns_good": f"SELECT {RETURN} FROM good_returns",
    "silver_returns_quarantine": f"SELECT {RETURN}, violations AS _violations FROM checked_returns WHERE violations <> ''",
    "silver_inventory_good": f"SELECT {STOCK} FROM good_inventory",
    "silver_inventory_quarantine": f"""SELECT {STOCK}, violations AS _violations FROM checked_inventory
        WHERE violations <> ''""",
    "violation_report": VIOLATIONS.format("checked_sales"),
    "violation_report_returns": VIOLATIONS.format("checked_returns"),
    "violation_report_inventory": VIOLATIONS.format("checked_inventory"),
    "quarantine_stats": f"""SELECT COUNT(*) AS rows_in, COUNT(*) FILTER (violations = '') AS kept,
        COUNT(*) FILTER (violations <> '') AS rejected,
        {rnd("COUNT(*) FILTER (violations <> '') / COUNT(*) * 100", 2)} AS rejected_pct FROM checked_sales""",
    "net_sales": f"""SELECT {SALE}, {big('returned_quantity')} AS returned_quantity,
        {big('kept_quantity')} AS kept_quantity, returned_amount, net_revenue FROM net""",
    "dedupe_sales": f"""SELECT {SALE} FROM good_sales
        QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY sold_at DESC, sku DESC) = 1""",
    "daily_sales": f"SELECT {DAILY} FROM daily",
    "top_products": """SELECT style_id, style_name, category, subcategory, season, units_sold, net_revenue, cost_of_goods,
        avg_discount_pct, sku_count, returned_units, margin_amount, return_rate_pct, revenue_rank FROM styles_ranked""",
    "sell_rate": "SELECT sku, store_id, daily_sell_rate FROM rates",
    "inventory_health": f"""SELECT {text('snapshot_date')}, sku, style_id, style_name, category, colour, size, store_id,
        store_name, city, {big('on_hand')} AS on_hand, on_order, daily_sell_rate, days_of_cover, status, stock_value
        FROM health""",
    "returns_analysis": "SELECT * FROM analysis",
    "size_curve": "SELECT * FROM curve",
    "style_markdown": "SELECT * FROM markdowns",
    "product_catalog": f"""SELECT * EXCLUDE (launch_date), {text('launch_date')} FROM catalog""",
    "style_catalog": f"SELECT {STYLE} FROM styles",
    "global_rank_scaled": f"""SELECT sku, store_id, {big('SUM(quantity)')} AS units,
        row_number() OVER (ORDER BY SUM(quantity) DESC NULLS LAST, sku, store_id) AS line_rank
        FROM good_sales GROUP BY 1, 2""",
    "usage_freshness": f"""SELECT CAST(MIN(usage_date) AS VARCHAR) AS earliest, CAST(MAX(usage_date) AS VARCHAR) AS latest,
        COUNT(*) AS "rows", COUNT(DISTINCT sku_name) AS distinct_skus, {rnd('SUM(usage_quantity)', 3)} AS total_dbus
        FROM usage""",
    "spend_by_day_sku": SPEND_BY_DAY,
    "interval_join_bucketed": SPEND_BY_DAY,
    "asof_join": SPEND_BY_DAY,
    "cost_per_job": f"""SELECT job_id, COUNT(DISTINCT job_run_id) AS runs, {SPEND} FROM priced
        WHERE job_id IS NOT NULL GROUP BY 1""",
    "spend_by_tag": f"SELECT purpose, owner, billing_origin_product, {SPEND} FROM priced GROUP BY 1, 2, 3",
    "spend_by_cluster": f"""SELECT cluster_source, cluster_name, {SPEND} FROM priced JOIN newest_clusters
        USING (cluster_id) GROUP BY 1, 2""",
    "current_clusters": "SELECT * FROM newest_clusters",
    "fanout_check": """SELECT 'raw' AS dimension, (SELECT COUNT(*) FROM usage) AS rows_in,
          (SELECT COUNT(*) FROM usage JOIN clusters USING (cluster_id)) AS rows_out, 3 AS max_versions
        UNION ALL
        SELECT 'collapsed', (SELECT COUNT(*) FROM usage),
          (SELECT COUNT(*) FROM usage JOIN newest_clusters USING (cluster_id)), 1""",
    "kpis": f"""SELECT {REVENUE}, {MARGIN}, {big('SUM(units_sold)')} AS units_sold,
        {rnd('SUM(discount_amount) / nullif(SUM(gross_amount), 0) * 100', 1)} AS discount_pct,
        {big('SUM(transactions)')} AS transactions FROM daily WHERE {LAST_DAYS}""",
    "trend": f"SELECT {text('sale_date')}, {REVENUE}, {MARGIN} FROM daily WHERE {LAST_DAYS} GROUP BY daily.sale_date",
    "revenue_by_category": f"SELECT category, {REVENUE} FROM daily WHERE {LAST_DAYS} GROUP BY 1",
    "returns_by_reason": f"""SELECT reason, {big('SUM(returned_units)')} AS returned_units,
        {rnd('CAST(SUM(CAST(round(avg_days_to_return * 10) AS BIGINT)) AS DOUBLE) / 10 / COUNT(*)', 1)} AS avg_days
        FROM analysis GROUP BY 1""",
    "inventory_by_status": f"""SELECT status, COUNT(*) AS lines, {rnd('SUM(stock_value)', 0)} AS stock_value FROM health
        GROUP BY 1""",
    "top_styles": f"""SELECT revenue_rank, style_name, category, season, units_sold,
        {rnd('net_revenue', 0)} AS net_revenue, margin_amount, avg_discount_pct, return_rate_pct FROM styles_ranked
        WHERE revenue_rank <= 12""",
    "worst_size_style": """SELECT style_id, MAX(abs(imbalance)) AS worst_imbalance FROM curve GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 1""",
    "size_curve_for_style": "SELECT size, demand_share, stock_share, signal FROM curve WHERE style_id = 'STY0005'",
    "inventory_lines": f"SELECT {INVENTORY_LINE} FROM health ORDER BY stock_value DESC, sku, store_id LIMIT 200",
    "inventory_lines_dead": f"""SELECT {INVENTORY_LINE} FROM health WHERE status = 'dead'
        ORDER BY stock_value DESC, sku, store_id LIMIT 200""",
    **{
        f"list_styles_{sort}": f"SELECT {WAY} FROM ways"
        for sort in ("featured", "new", "price_low", "price_high", "discount")
    },
    "list_styles_filtered": f"""SELECT {WAY} FROM ways WHERE category = 'Tops' AND colour = 'Navy'
        AND list_contains(string_split(sizes_in_stock, ','), 'M') AND list_price > current_price + 1""",
    "facets": f"""SELECT 'colour' AS facet, 'Navy' AS value, 0 AS place
        WHERE EXISTS (SELECT 1 FROM styles WHERE colour = 'Navy')
        UNION ALL
        SELECT 'size', size, {SIZE_RANK} FROM (SELECT DISTINCT unnest(string_split(sizes_all, ',')) AS size
          FROM styles WHERE colour = 'Navy')""",
    "shelves": """SELECT * FROM (
          SELECT 'new_in' AS shelf, row_number() OVER (ORDER BY popularity_rank) AS position, product_id FROM styles
          WHERE in_stock AND is_new QUALIFY position <= 8)
        UNION ALL SELECT * FROM (
          SELECT 'trending', row_number() OVER (ORDER BY popularity_rank) AS position, product_id FROM styles
          WHERE in_stock QUALIFY position <= 8)
        UNION ALL SELECT * FROM (
          SELECT 'reduced', row_number() OVER (ORDER BY list_price - current_price DESC, popularity_rank) AS position,
          product_id FROM styles WHERE in_stock AND list_price > current_price + 1 QUALIFY position <= 4)""",
    "styles_per_category": "SELECT category, COUNT(*) AS styles FROM styles GROUP BY 1",
    "catalogue_values": "SELECT DISTINCT colour FROM products",
    "catalogue_bundle": f"""SELECT s.* EXCLUDE (launch_date, popularity_rank), {text('launch_date')}, z.sizes, w.colourways
        FROM styles s
        JOIN (SELECT product_id, string_agg(size || ':' || sku || ':' || on_hand || ':' || CAST(list_price AS BIGINT) || ':'
              || CAST(current_price AS BIGINT), ',' ORDER BY {SIZE_RANK}, size, sku) AS sizes
              FROM catalog GROUP BY 1) z USING (product_id)
        JOIN (SELECT style_id, string_agg(product_id, ',' ORDER BY popularity_rank) AS colourways
              FROM styles GROUP BY 1) w ON s.style_id = w.style_id""",
    "fit_note": f"""SELECT category, reason, returned_units,
        {rnd('returned_units / SUM(returned_units) OVER (PARTITION BY category) * 100', 0)} AS share,
        reason IN ('size', 'fit') AS take_larger FROM analysis
        QUALIFY row_number() OVER (PARTITION BY category ORDER BY returned_units DESC, reason) = 1""",
    "shown_discount": f"""SELECT sku, list_price, current_price, CASE WHEN list_price > current_price + 1
        THEN CAST(round_even((list_price - current_price) / list_price * 100, 0) AS BIGINT) END AS shown_discount
        FROM catalog""",
    "conform_customer": """SELECT order_id, customer_name AS name, customer_email AS email,
        left(repeat('+91 ' || o_custkey, 4), 20) AS phone, o_custkey || ' Market Road' AS address, city,
        left(repeat(lpad(CAST(o_custkey AS VARCHAR), 6, '0'), 3), 10) AS postcode FROM book""",
    "order_status_latest": f"SELECT order_id, status, {moment('updated_at')}, note, total FROM current",
    "order_status_strict": f"""SELECT order_id, coalesce(t.status, b.status) AS status,
        strftime(coalesce(t.updated_at, b.placed_at), '%Y-%m-%d %H:%M:%S') AS updated_at, t.note, total
        FROM book b LEFT JOIN taken t USING (order_id)""",
    "illegal_transitions": f"SELECT order_id, seq, status, note, {moment('updated_at')}, met FROM judged WHERE NOT legal",
    "order_tracking": """SELECT order_id, status,
        CASE status WHEN 'placed' THEN 0 WHEN 'packed' THEN 1 WHEN 'shipped' THEN 2 WHEN 'delivered' THEN 3 END AS stage,
        CASE status WHEN 'placed' THEN 'packed,cancelled' WHEN 'packed' THEN 'shipped,cancelled'
          WHEN 'shipped' THEN 'delivered' ELSE '' END AS actions FROM current""",
    "unknown_statuses": f"SELECT order_id, seq, status, note, {moment('updated_at')} FROM changes WHERE status = 'lost'",
    "orders_by_email": f"""SELECT order_id, {moment('placed_at')}, status, item_count, total FROM current
        WHERE lower(customer_email) = 'c7@example.com' ORDER BY current.placed_at DESC, order_id LIMIT 25""",
    "recent_orders": f"SELECT {ORDER_LINE} FROM current ORDER BY current.placed_at DESC, order_id LIMIT 60",
    **{
        f"recent_orders_{status}": f"""SELECT {ORDER_LINE} FROM current WHERE status = '{status}'
        ORDER BY current.placed_at DESC, order_id LIMIT 100"""
        for status in ("placed", "packed")
    },
    "order_summary": f"""SELECT status, COUNT(*) AS orders, {big('SUM(item_count)')} AS units,
        {rnd('SUM(total)', 0)} AS value FROM current GROUP BY 1""",
    "order_rollup": """SELECT COUNT(*) FILTER (status IN ('placed', 'packed', 'shipped')) AS open_orders,
        COUNT(*) AS orders_taken, SUM(total) AS lifetime_value FROM current""",
    "order_documents": """SELECT b.order_id, b.status, b.total, coalesce(p.page, 0) AS page,
        coalesce(string_agg(line_no || ':' || sku, ',' ORDER BY line_no, sku), '') AS lines
        FROM current b LEFT JOIN (SELECT *, (line_no - 1) // 1000 AS page FROM book_lines) p
        ON b.order_id = p.order_id GROUP BY 1, 2, 3, 4""",
    "reserved_units": "SELECT * FROM reserved",
    "availability": "SELECT sku, product_id, available FROM available",
    "style_availability": f"""SELECT product_id, {big('greatest(0, SUM(on_hand) - coalesce(SUM(reserved), 0))')} AS available,
        SUM(on_hand) - coalesce(SUM(reserved), 0) <= 0 AS sold_out
        FROM catalog LEFT JOIN reserved USING (sku) GROUP BY 1""",
    "price_bags": f"""SELECT bag_id, lines, {big('items')} AS items, subtotal, saved, short,
        CASE WHEN lines = 0 OR subtotal >= 2999 THEN 0.0 ELSE 149.0 END::DOUBLE AS delivery,
        (subtotal + CASE WHEN lines = 0 OR subtotal >= 2999 THEN 0 ELSE 149 END)::DOUBLE AS total,
        CASE WHEN lines = 0 THEN 0.0 ELSE greatest(0, 2999 - subtotal) END::DOUBLE AS to_free_delivery FROM bag_totals""",
    "format_report": f"""SELECT category, channel, strftime(sale_date, '%d %b') AS day,
        strftime(sale_date, '%d %b, %H:%M') AS moment, {grouped(WHOLE)} || '.00' AS rupees,
        '₹' || {grouped(WHOLE)} AS price, {COMPACT} AS compact, {grouped('units_sold')} AS units,
        CAST(CAST(margin_pct AS DECIMAL(18,1)) AS VARCHAR) || '%' AS margin FROM daily""",
    "ingest_rescue": """SELECT CASE WHEN NOT broken THEN transaction_id END AS transaction_id,
        CASE WHEN NOT broken THEN sku END AS sku, CASE WHEN NOT broken THEN store_id END AS store_id,
        CASE WHEN NOT broken THEN strftime(sold_at, '%Y-%m-%dT%H:%M:%S') END AS sold_at,
        CASE WHEN NOT broken AND NOT mistyped THEN quantity END AS quantity,
        CASE WHEN NOT broken THEN unit_price END AS unit_price, CASE WHEN NOT broken THEN list_price END AS list_price,
        CASE WHEN NOT broken THEN discount_pct END AS discount_pct,
        CASE WHEN NOT broken THEN customer_id END AS customer_id, CASE WHEN NOT broken THEN promo END AS promo,
        CASE WHEN broken THEN '{"transaction_id":"' || transaction_id || '",'
             WHEN mistyped THEN '{"quantity":"x"}' END AS _rescued_data, dt FROM drops""",
    "ingest_idempotent": """SELECT dt, COUNT(*) AS "rows",
        COUNT(DISTINCT CASE WHEN NOT broken THEN transaction_id END) AS transactions FROM drops GROUP BY 1""",
    "ingest_provenance": """SELECT dt, 0 AS ingest_batch, COUNT(*) AS "rows", COUNT(*) AS traced, COUNT(*) AS stamped
        FROM drops GROUP BY 1""",
    "drops_late_rows": """SELECT dt, COUNT(*) AS "rows",
        COUNT(DISTINCT CASE WHEN NOT broken THEN transaction_id END) AS transactions FROM drops GROUP BY 1""",
    "ingest_tail": """SELECT name, type, COUNT(*) AS "rows" FROM (
          SELECT 'k' || (l_orderkey % 1000) AS name, CASE WHEN l_orderkey % 2 = 0 THEN 'BIGINT' ELSE 'STRING' END AS type FROM raw_sales
          UNION ALL SELECT unnest(['transaction_id', 'sku', 'store_id', 'sold_at', 'customer_id']), 'STRING' FROM raw_sales) GROUP BY 1, 2""",
    "ingest_once": """SELECT COUNT(*) AS "rows", COUNT(DISTINCT transaction_id) AS transactions FROM
        (SELECT DISTINCT CASE WHEN NOT broken THEN transaction_id END AS transaction_id,
          CASE WHEN broken THEN transaction_id END AS cut FROM drops)""",
    "quarantine_rerun": """SELECT transaction_id, violations, 'bronze.sales' AS source_table, true AS dated
        FROM checked_sales WHERE violations <> ''""",
    "quality_report": " UNION ALL ".join(
        f"SELECT '{stream}' AS stream, * FROM ({VIOLATIONS.format(f'checked_{stream}')})"
        for stream in ("sales", "returns", "inventory")
    ),
    "overwrite_schema": f"SELECT category, {big('SUM(units_sold)')} AS units FROM daily GROUP BY 1",
    "append_evolving": """SELECT season, COUNT(*) AS "rows", COUNT(CASE WHEN season <> 'SS26' THEN colour END) AS coloured
        FROM products GROUP BY 1""",
    "place_orders": f"""SELECT coalesce(c.status, 'placed') AS status, COUNT(*) AS orders,
        {big('SUM(item_count)')} AS units, {big('SUM(u.units)')} AS line_units
        FROM book b LEFT JOIN last_change c USING (order_id) LEFT JOIN (SELECT order_id, SUM(quantity) AS units
          FROM book_lines GROUP BY 1) u USING (order_id) GROUP BY 1""",
    "order_document_by_id": f"""SELECT order_id, status, total, 0 AS page, l_linenumber AS line_no, {L['sku']} AS sku,
        {L['style_id']} || '-' || upper(left({L['colour']}, 3)) AS product_id, {L['style_name']} AS style_name,
        {L['category']} AS category, {L['colour']} AS colour, {L['size']} AS size, {big('l_quantity')} AS quantity,
        {rnd(L['retail_price'] + ' * (1 - l_discount)', 0)} AS unit_price, {L['retail_price']} AS list_price,
        {rnd(rnd(L['retail_price'] + ' * (1 - l_discount)', 0) + ' * CAST(l_quantity AS BIGINT)', 2)} AS line_total
        FROM current JOIN lineitem ON l_orderkey = o_orderkey WHERE order_id = 'ORD-7'""",
    "availability_of": f"""SELECT sku, {big('coalesce(available, 0)')} AS available FROM (SELECT DISTINCT sku FROM bag
        UNION ALL SELECT 'no-such-sku') LEFT JOIN available USING (sku)""",
    "bag_lines": f"""SELECT bag_id, sku, product_id, quantity, list_price, current_price, available,
        {rnd('current_price * quantity', 2)} AS line_total, quantity > available AS short FROM bag JOIN available USING (sku)""",
    "table_detail": """SELECT COUNT(*) AS "rows", 5 AS num_files, true AS mean_fits, true AS largest_fits FROM good_sales""",
    "compact": f"""SELECT COUNT(*) AS "rows", {big('SUM(units_sold)')} AS units_sold, true AS few_files, true AS fewer_files
        FROM daily""",
    "ingest_evolving": """SELECT dt, COUNT(*) AS "rows",
        COUNT(CASE WHEN NOT broken AND sale_date >= DATE '2026-08-15' THEN promo END) AS promo_rows FROM drops
        GROUP BY 1""",
    "delete_days": f"""SELECT {text('sale_date')}, NOT bool_or(gone) AS kept_files, COUNT(*) FILTER (NOT gone) AS "rows",
        {big('coalesce(SUM(units_sold) FILTER (NOT gone), 0)')} AS units_sold FROM unwanted_days GROUP BY unwanted_days.sale_date""",
    "late_returns": f"SELECT {DAILY} FROM daily",
    "late_returns_files": f"""SELECT {text('sale_date')}, sale_date NOT IN (SELECT sale_date FROM late_days) AS kept_sales,
        sale_date NOT IN (SELECT sale_date FROM late_days) AS kept_daily FROM (SELECT DISTINCT sale_date FROM daily)""",
    "delete_where": f"SELECT {DAILY} FROM daily WHERE net_revenue <= 10000000",
    "version_diff": f"SELECT 'removed' AS change, 1 AS copies, {DAILY} FROM daily WHERE net_revenue > 10000000",
}

ORACLES: dict[str, str] = {name: oracle(body) for name, body in BODIES.items()}

# Written twice or counted on the way, the result is the same.
ORACLES |= {"landing_retried": ORACLES["drops_late_rows"], "quarantine_observed": ORACLES["quarantine_stats"], "place_orders_again": ORACLES["place_orders"]}

# The bag as a recursion over each bag's ordered events.
ORACLES["fold_bags"] = """
WITH RECURSIVE e AS (
  SELECT user_id AS b, json_extract_string(props, '$.k') AS k, least(10, 1 + event_id % 12) AS q,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'add' WHEN event_type = 'view' THEN 'set' ELSE 'remove' END AS o,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE event_type IN ('purchase', 'click', 'view', 'error') AND user_id IS NOT NULL
    AND json_extract_string(props, '$.k') <> ''
),
f AS (
  SELECT DISTINCT b, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k VARCHAR, q BIGINT)[]) AS l FROM e
  UNION ALL
  SELECT f.b, e.n, CASE
    WHEN o = 'remove' THEN list_filter(l, lambda x: x.k <> e.k)
    WHEN len(list_filter(l, lambda x: x.k = e.k)) > 0 THEN list_transform(l, lambda x: CASE WHEN x.k <> e.k THEN x
      ELSE {'k': x.k, 'q': CASE WHEN o = 'add' THEN least(10, x.q + e.q) ELSE e.q END} END)
    WHEN o = 'add' AND len(l) < 20 THEN list_append(l, {'k': e.k, 'q': e.q})
    ELSE l END
  FROM f JOIN e ON e.b = f.b AND e.n = f.n + 1
),
g AS (SELECT b, arg_max(l, n) AS l FROM f GROUP BY b)
SELECT b AS bag_id, i AS line_no, l[i].k AS sku, l[i].q AS quantity FROM g, unnest(range(1, len(l) + 1)) AS r(i)
"""

ORACLES["fold_bags_stream"] = ORACLES["fold_bags"]
