-- Public export: one row per (order_date, region).
SELECT order_date, region, CAST(SUM(amount) AS DECIMAL(18,2)) AS revenue
FROM stg_orders
GROUP BY order_date, region
