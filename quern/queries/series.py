"""Generated series and time-series recipes."""

from quern.queries import statements

statements({
    "generate_series_int": ("SELECT value FROM GENERATE_SERIES(1, 20, 3)", "SELECT generate_series AS value FROM generate_series(1, 20, 3)"),
    "generate_series_desc": ("SELECT value FROM GENERATE_SERIES(5, 1)", "SELECT generate_series AS value FROM generate_series(5, 1, -1)"),
    "generate_series_float": ("SELECT x FROM GENERATE_SERIES(0.0, 2.0, 0.5) AS g(x)", "SELECT i * 0.5::DOUBLE AS x FROM range(5) t(i)"),
    "generate_series_timestamp": ("SELECT t FROM GENERATE_SERIES(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL '6 hours') AS g(t)", "SELECT generate_series AS t FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 6 HOUR)"),
    "generate_series_by_type": ("SELECT x FROM GENERATE_SERIES(-1.5, 2) AS g(x) UNION ALL SELECT value FROM GENERATE_SERIES(0.0, 2.0, -0.5)", "SELECT * FROM (VALUES (-1.5::DOUBLE), (-0.5), (0.5), (1.5)) t(x)"),
    "generate_series_scalar": ("SELECT GENERATE_SERIES(1, 5) AS a, GENERATE_SERIES(0, 10, 2) AS b, GENERATE_SERIES(0, 1, 0.5) AS c", "SELECT '[1, 2, 3, 4, 5]' AS a, '[0, 2, 4, 6, 8, 10]' AS b, '[0, 0.5, 1]' AS c"),
    "generate_series_column": ("SELECT n_nationkey, GENERATE_SERIES(n_regionkey, 2) AS s FROM nation WHERE n_regionkey < 2", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN '[0, 1, 2]' ELSE '[1, 2]' END AS s FROM nation WHERE n_regionkey < 2"),
    "generate_series_join": ("SELECT s.value AS k, n_name FROM GENERATE_SERIES(0, 30) s LEFT JOIN nation ON n_nationkey = s.value", "SELECT s.generate_series AS k, n_name FROM generate_series(0, 30) s LEFT JOIN nation ON n_nationkey = s.generate_series"),
    "ts_time_trunc_15m": ("SELECT TIME_TRUNC('15m', ts) AS b, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS s FROM events GROUP BY TIME_TRUNC('15m', ts), event_type", "SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS b, event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1, 2"),
    "ts_ohlc": ("SELECT TIME_TRUNC('1h', ts) AS b, FIRST(value ORDER BY ts) AS o, MAX(value) AS h, MIN(value) AS l, LAST(value ORDER BY ts) AS c FROM events GROUP BY TIME_TRUNC('1h', ts)", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, ts) AS c FROM events GROUP BY 1"),
    "ts_gapfill_lag": (
        "WITH g AS (SELECT t FROM GENERATE_SERIES(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08', INTERVAL '1 hour') AS x(t)), h AS (SELECT TIME_TRUNC('1h', ts) AS t, COUNT(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY TIME_TRUNC('1h', ts)) SELECT g.t AS t, COALESCE(h.n, 0) AS n, LAG(COALESCE(h.n, 0)) OVER (ORDER BY g.t) AS before FROM g LEFT JOIN h ON g.t = h.t",
        "WITH g AS (SELECT generate_series AS t FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08', INTERVAL 1 HOUR)), h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS t, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT g.t AS t, coalesce(h.n, 0) AS n, lag(coalesce(h.n, 0)) OVER (ORDER BY g.t) AS before FROM g LEFT JOIN h ON g.t = h.t",
    ),
})
