"""Window functions, frames and named windows."""

from quern.queries import statements

_BY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _over(call: str, oracle: str | None = None, by: str = _BY):
    text = "SELECT o_orderkey, {} OVER ({}) AS x FROM orders"
    return (text.format(call, by), text.format(oracle or call, by))


statements({
    "win_row_number": _over("ROW_NUMBER()"),
    "win_rank": _over("RANK()", by="PARTITION BY o_custkey ORDER BY o_orderpriority"),
    "win_dense_rank": _over("DENSE_RANK()", by="PARTITION BY o_custkey ORDER BY o_orderpriority DESC NULLS FIRST"),
    "win_ntile": _over("NTILE(4)"),
    "win_lead_default": _over("LEAD(o_totalprice, 1, 0.0)"),
    "win_lag_offset": _over("LAG(o_orderkey, 2)"),
    "win_first_value": _over("FIRST_VALUE(o_totalprice)"),
    "win_last_value": _over("LAST_VALUE(o_totalprice)"),
    "win_nth_value": _over("NTH_VALUE(o_orderkey, 3)"),
    "win_percent_rank": ("SELECT o_orderkey, ROUND(PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS x FROM orders",),
    "win_cume_dist": ("SELECT o_orderkey, ROUND(CUME_DIST() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS x FROM orders",),
    "win_running_sum_peers": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 2) AS x FROM orders",
    "win_rows_frame": "SELECT o_orderkey, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS x FROM orders",
    "win_range_offset": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM orders",
    "win_unbounded_following": "SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM orders",
    "win_named": "SELECT o_orderkey, ROW_NUMBER() OVER w AS a, MIN(o_totalprice) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_over_group_by": "SELECT o_orderstatus, o_orderpriority, RANK() OVER (PARTITION BY o_orderstatus ORDER BY COUNT(*) DESC, o_orderpriority) AS r, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "win_in_expression": "SELECT o_orderkey, ROUND(o_totalprice - LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS x FROM orders",
    "win_count_distinct": ("SELECT o_orderkey, COUNT(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS x FROM orders",),
    "win_count_distinct_null": ("SELECT o_orderkey, COUNT(DISTINCT NULLIF(o_orderpriority, '5-LOW')) OVER (PARTITION BY o_custkey) AS x FROM orders",),
    "win_string_agg_ordered": ("SELECT n_nationkey, STRING_AGG(n_name, ',' ORDER BY n_name DESC) OVER (PARTITION BY n_regionkey) AS x FROM nation", "SELECT n_nationkey, s AS x FROM nation JOIN (SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name DESC) AS s FROM nation GROUP BY n_regionkey) ON n_regionkey = r"),
    "win_filter": "SELECT o_orderkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS x FROM orders",
    "win_nulls_ordering": "SELECT c, ROW_NUMBER() OVER (ORDER BY k, c) AS x FROM (SELECT c_custkey AS c, NULLIF(c_nationkey, 7) AS k FROM customer) t",
    "win_topn_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 2",
    "win_three_windows": "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS b, COUNT(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders",
    "win_stats": "SELECT o_orderkey, ROUND(STDDEV_SAMP(o_totalprice) OVER (PARTITION BY o_orderstatus), 3) AS x FROM orders",
})
