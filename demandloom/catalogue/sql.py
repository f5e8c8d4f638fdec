"""Building blocks of the SQL side: common table expressions in dependency order."""

from __future__ import annotations

CTES: dict[str, str] = {
    "sales": """SELECT CAST(l_shipdate AS DATE) AS date, r_name AS state_id, n_name AS store_id, p_type AS cat_id, p_type || '/' || substr(p_brand, 7, 1) AS dept_id, p_brand AS item_id, l_quantity AS units, l_extendedprice AS revenue, l_discount >= 0.05::DOUBLE AS promo
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""",
    "panel": "SELECT level, key, date, sum(units) AS y, sum(revenue) AS revenue, sum(CASE WHEN promo THEN units ELSE 0 END) AS promo_units, sum(revenue / nullif(units, 0)) AS price_sum, sum(promo::INT)::BIGINT AS promo_sum, count(*) AS n FROM ("
      "SELECT 'total' AS level, 'TOTAL' AS key, * FROM sales UNION ALL SELECT 'state', state_id, * FROM sales UNION ALL SELECT 'store', store_id, * FROM sales UNION ALL SELECT 'store_cat', store_id || '|' || cat_id, * FROM sales) GROUP BY level, key, date",
    "panel6": "SELECT level, key, date, y FROM panel UNION ALL SELECT 'store_dept', store_id || '|' || dept_id, date, sum(units) FROM sales GROUP BY ALL UNION ALL SELECT 'store_item', store_id || '|' || cat_id || '|' || item_id, date, sum(units) FROM sales GROUP BY ALL",
    "bounds": "SELECT min(date) AS a, max(date) AS b FROM sales",
    "grid": """SELECT k.level, k.key, d.date, coalesce(p.y, 0) AS y, coalesce(p.revenue, 0) AS revenue, coalesce(p.promo_units, 0) AS promo_units, coalesce(p.price_sum, 0) AS price_sum, coalesce(p.promo_sum, 0) AS promo_sum, coalesce(p.n, 0) AS n
      FROM (SELECT DISTINCT level, key FROM panel) k CROSS JOIN (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM bounds) d LEFT JOIN panel p ON p.level = k.level AND p.key = k.key AND p.date = d.date""",
    "folds": "SELECT k AS fold, (b + (1 - 28 * (7 - k))::INT)::DATE AS origin FROM bounds, (SELECT unnest(range(1, 7)) AS k)",
    "hist": "SELECT fold, level, key, list(y ORDER BY date) AS ys FROM grid JOIN folds ON date < origin WHERE level != 'store_cat' GROUP BY fold, level, key",
    "future": "SELECT fold, level, key, date_diff('day', origin, date)::INT + 1 AS h, y FROM grid JOIN folds ON date >= origin AND date < origin + 28 WHERE level != 'store_cat'",
    "ses": """SELECT fold, level, key, arg_min(s.level, (s.sse, alpha)) AS yhat, arg_min(alpha, (s.sse, alpha)) AS alpha FROM (SELECT fold, level, key, alpha,
      list_reduce(list_transform(ys[2:], lambda v: {'y': v, 'level': 0::DOUBLE, 'sse': 0::DOUBLE}), lambda st, x: {'y': x.y, 'level': alpha * x.y + (1 - alpha) * st.level, 'sse': st.sse + (x.y - st.level) * (x.y - st.level)}, {'y': 0::DOUBLE, 'level': ys[1], 'sse': 0::DOUBLE}) AS s
      FROM hist, (SELECT round(0.05::DOUBLE * unnest(range(1, 20)), 2) AS alpha)) GROUP BY fold, level, key""",
    "croston": """SELECT fold, level, key, CASE WHEN len(pts) = 0 THEN 0 WHEN len(pts) = 1 THEN pts[1].y / n ELSE s.z / greatest(s.p, 1e-9::DOUBLE) * 0.95::DOUBLE END AS yhat FROM (SELECT *,
      list_reduce(pts[2:], lambda st, x: {'z': 0.1::DOUBLE * x.y + 0.9::DOUBLE * st.z, 'p': 0.1::DOUBLE * (x.i - st.i) + 0.9::DOUBLE * st.p, 'i': x.i, 'y': x.y}, {'z': pts[1].y, 'p': pts[1].i, 'i': pts[1].i, 'y': pts[1].y}) AS s
      FROM (SELECT fold, level, key, len(ys) AS n, list_filter(list_transform(ys, lambda v, i: {'z': 0::DOUBLE, 'p': 0::DOUBLE, 'i': i::DOUBLE, 'y': v}), lambda x: x.y > 0) AS pts FROM hist))""",
    "backtest": """SELECT fold, level, key, method, h, y, CASE method WHEN 'naive' THEN ys[-1] WHEN 'seasonal_naive' THEN ys[len(ys) - 6 + (h - 1) % 7] WHEN 'ses' THEN s.yhat ELSE c.yhat END AS yhat
      FROM future JOIN hist USING (fold, level, key) JOIN ses s USING (fold, level, key) JOIN croston c USING (fold, level, key), (SELECT unnest(['naive', 'seasonal_naive', 'ses', 'croston_sba']) AS method)""",
    "weekly": "SELECT store_id || '|' || cat_id AS key, (date_trunc('week', date)::DATE + 6)::DATE AS week, sum(units) AS units, avg(revenue / nullif(units, 0)) AS price, avg(promo::INT) AS promo FROM sales GROUP BY 1, 2",
    "classes": """SELECT level, key, adi, cv2, CASE WHEN adi < 1.32::DOUBLE AND cv2 < 0.49::DOUBLE THEN 'smooth' WHEN adi < 1.32::DOUBLE THEN 'erratic' WHEN cv2 < 0.49::DOUBLE THEN 'intermittent' ELSE 'lumpy' END AS class FROM (
      SELECT level, key, count(*)::DOUBLE / nullif(count(*) FILTER (WHERE y != 0), 0) AS adi, coalesce((stddev_pop(y) FILTER (WHERE y != 0) / avg(y) FILTER (WHERE y != 0)) ** 2, 0) AS cv2 FROM grid GROUP BY level, key)""",
}

CTES["classes_before"] = CTES["classes"].replace("FROM grid GROUP BY", "FROM grid WHERE date < (SELECT origin FROM folds WHERE fold = 4) GROUP BY")

NEEDS: dict[str, tuple[str, ...]] = {
    "sales": (), "panel": ("sales",), "bounds": ("sales",), "grid": ("panel", "bounds"), "folds": ("bounds",), "hist": ("grid", "folds"), "future": ("grid", "folds"),
    "ses": ("hist",), "croston": ("hist",), "backtest": ("future", "hist", "ses", "croston"), "weekly": ("sales",), "classes": ("grid",), "classes_before": ("grid", "folds"), "panel6": ("panel", "sales"),
}


def with_(names: str, body: str, **more: str) -> str:
    """body with the named expressions, what they need, and more of its own in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" if n in ("grid", "backtest", "hist") else f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
