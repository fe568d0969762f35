-- Private staging rows, inline so the fixture needs no input files.
SELECT * FROM (VALUES
    (10, DATE '2025-03-01', 'north', CAST(15.25 AS DECIMAL(5,2))),
    (11, DATE '2025-03-01', 'north', CAST(4.75 AS DECIMAL(5,2))),
    (12, DATE '2025-03-01', 'south', CAST(99.99 AS DECIMAL(5,2))),
    (13, DATE '2025-03-02', 'north', CAST(10.00 AS DECIMAL(5,2))),
    (14, DATE '2025-03-02', 'west', CAST(1.01 AS DECIMAL(5,2)))
) AS t(order_id, order_date, region, amount)
