"""DuckDB definitions of the sample tables, as named common table expressions."""

from __future__ import annotations

import re

from tillweave.sources.sample_tables import EVENT_RULES, SECOND_EVENT_RULE, SNAP_RULES


def _case(rules: list[tuple[str, str, str]], field: int) -> str:
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    whens = " ".join(f"WHEN {r[2]} THEN {text(r[field])}" for r in rules)
    return f"CASE {whens} END"


_SNAP = ", ".join(
    f"CAST(dd BETWEEN {lo} AND {hi} AS INTEGER) AS snap_{state}"
    for state, (lo, hi) in SNAP_RULES.items()
)

CTES: dict[str, str] = {
    "bounds": """
SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem""",
    "sales_lines": """
SELECT item_id || '_' || store_id || '_evaluation' AS id, *
FROM (SELECT *, dept_id || '_' || lpad(CAST(brand_no AS VARCHAR), 3, '0') AS item_id,
             split_part(dept_id, '_', 1) AS cat_id,
             state_id || '_' || CAST(store_no AS VARCHAR) AS store_id
      FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS INTEGER) AS quantity,
                   CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, brand_no,
                   CASE l_returnflag WHEN 'R' THEN 'CA' WHEN 'A' THEN 'TX' ELSE 'WI' END AS state_id,
                   CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 2 ELSE 1 END AS store_no,
                   ['FOODS_1', 'FOODS_2', 'HOUSEHOLD_1', 'HOUSEHOLD_2', 'HOBBIES_1'][(brand_no - 1) // 5 + 1] AS dept_id
            FROM lineitem JOIN (SELECT p_partkey, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_no FROM part)
              ON l_partkey = p_partkey))""",
    "prodloc": """
SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM sales_lines""",
    "sales_long": """
SELECT p.id, g.date, CAST(coalesce(s.sales, 0) AS INTEGER) AS sales
FROM prodloc p
CROSS JOIN (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds) g
LEFT JOIN (SELECT id, date, sum(CASE WHEN date >= lo + 30 * brand_no THEN quantity ELSE 0 END) AS sales
           FROM sales_lines, bounds GROUP BY id, date) s
  ON s.id = p.id AND s.date = g.date""",
    "sell_prices": """
SELECT store_id, item_id, CAST(floor((date - lo) / 7) AS INTEGER) AS wm_yr_wk,
       CAST(sum(cents) AS DOUBLE) / (100.0::DOUBLE * CAST(sum(quantity) AS DOUBLE)) AS sell_price
FROM sales_lines, bounds GROUP BY ALL""",
    "calendar": f"""
SELECT date, 'd_' || CAST(i + 1 AS VARCHAR) AS d, CAST(floor(i / 7) AS INTEGER) AS wm_yr_wk,
       dayname(date) AS weekday, CAST((dayofweek(date) + 1) % 7 + 1 AS INTEGER) AS wday,
       {_case(EVENT_RULES, 0)} AS event_name_1, {_case(EVENT_RULES, 1)} AS event_type_1,
       {_case([SECOND_EVENT_RULE], 0)} AS event_name_2, {_case([SECOND_EVENT_RULE], 1)} AS event_type_2,
       {_SNAP}
FROM (SELECT date, date - lo AS i, month(date) AS m, day(date) AS dd, isodow(date) AS wd
      FROM (SELECT lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds))""",
    "event_days": """
SELECT date, event_name_1 AS event_name, event_type_1 AS event_type FROM calendar WHERE event_name_1 IS NOT NULL
UNION ALL
SELECT date, event_name_2, event_type_2 FROM calendar WHERE event_name_2 IS NOT NULL""",
    "lifecycle": """
SELECT id, min(date) AS first_sales_date, max(date) AS last_sales_date, CAST(sum(sales) AS BIGINT) AS total_sales
FROM sales_long WHERE sales > 0 GROUP BY id""",
    "sales_trim": """
SELECT s.* FROM sales_long s JOIN lifecycle l ON s.id = l.id AND s.date >= l.first_sales_date""",
    "zero_rows": """
SELECT *, CASE WHEN sales = 0 THEN 1 ELSE 0 END AS zero_sales_ind FROM sales_trim""",
    "zero_periods": """
SELECT id, date, zero_sales_ind, CAST(sum(start) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) * zero_sales_ind AS period
FROM (SELECT *, greatest(zero_sales_ind - lag(zero_sales_ind) OVER (PARTITION BY id ORDER BY date),
                         CASE WHEN lag(zero_sales_ind) OVER (PARTITION BY id ORDER BY date) IS NULL THEN NULL ELSE 0 END) AS start
      FROM zero_rows)""",
    "oos_runs": """
SELECT r.id, r.period, CASE WHEN pow(p.p, r.k) <= 0.001 THEN 1 ELSE 0 END AS flag
FROM (SELECT id, period, count(*) AS k FROM zero_periods WHERE zero_sales_ind = 1 AND period IS NOT NULL GROUP BY id, period) r
JOIN (SELECT id, avg(zero_sales_ind) AS p FROM zero_rows GROUP BY id) p ON r.id = p.id""",
    "sales_oos": """
SELECT z.id, z.date, z.sales, z.zero_sales_ind, CAST(coalesce(f.flag, 0) AS INTEGER) AS OOS
FROM zero_rows z
LEFT JOIN (SELECT q.id, q.date, o.flag FROM zero_periods q JOIN oos_runs o ON q.id = o.id AND q.period = o.period
           WHERE q.zero_sales_ind = 1) f ON z.id = f.id AND z.date = f.date""",
}


def _used(text: str, known) -> list[str]:
    words = set(re.findall(r"\w+", text))
    return [name for name in known if name in words]


def with_fixtures(body: str, extra: dict[str, str] | None = None) -> str:
    """Prepend the CTEs that a query body uses, in dependency order."""
    pool = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _used(text, pool):
            if name not in needed:
                visit(pool[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    heads = ",\n".join(f"{name} AS ({pool[name].strip()})" for name in needed)
    return f"WITH {heads}\n{body.strip()}"
