"""Scans, filters, joins, subqueries, aggregation, sorting, set operations and common table expressions."""

from quern.queries import statements

statements({
    "flagship": """SELECT * FROM (SELECT n_name, DATE_TRUNC('month', o_orderdate) AS month, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue,
        RANK() OVER (PARTITION BY DATE_TRUNC('month', o_orderdate) ORDER BY SUM(l_extendedprice * (1 - l_discount)) DESC) AS r
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name, DATE_TRUNC('month', o_orderdate) HAVING COUNT(*) > 1) AS x WHERE r <= 3""",
    # scan, filter, project
    "scan_filter_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08",
    "scan_in_list": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('F')",
    "scan_not_in_null": "SELECT COUNT(*) AS n FROM orders WHERE o_orderkey NOT IN (1, 2, NULL)",
    "scan_pk_lookup": "SELECT * FROM customer WHERE c_custkey = 42",
    "scan_keyset_page": "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 20",
    "scan_min_max_count": "SELECT MIN(o_orderkey) AS a, MAX(o_orderkey) AS b, COUNT(*) AS n FROM orders",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' AND p_name NOT LIKE '%t'",
    "filter_ilike": "SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%'",
    "filter_like_escape": ("SELECT c_custkey FROM customer WHERE c_name || '_x%' LIKE '%!_x!%' ESCAPE '!' AND c_custkey < 50",),
    "filter_glob": "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[12]?'",
    "filter_regexp": ("SELECT p_partkey, p_name FROM part WHERE p_name REGEXP '^(red|blue) .*g' AND NOT p_type REGEXP 'ECO'", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*g') AND NOT regexp_matches(p_type, 'ECO')"),
    "filter_is_distinct_from": "SELECT COUNT(*) AS n FROM orders WHERE NULLIF(o_orderstatus, 'F') IS DISTINCT FROM 'O' AND NULLIF(o_orderstatus, 'P') IS NOT DISTINCT FROM NULL OR o_orderstatus = 'F'",
    "filter_xor": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' XOR o_totalprice > 200000", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 200000)"),
    "filter_is_true": "SELECT COUNT(*) AS n FROM orders WHERE (o_totalprice > 100000) IS TRUE AND (NULLIF(o_orderstatus, 'F') = 'O') IS NOT FALSE",
    "filter_alias_in_where": ("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE doubled > 900000", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_totalprice * 2 > 900000"),
    "project_case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders",
    "project_case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS s FROM orders",
    "project_arith_int_div": ("SELECT c_custkey, c_custkey / 7 AS q, (0 - c_custkey) / 7 AS m, c_custkey / 2.0 AS f FROM customer", "SELECT c_custkey, c_custkey // 7 AS q, CAST(trunc((0 - c_custkey) / 7.0) AS BIGINT) AS m, c_custkey / 2.0::DOUBLE AS f FROM customer"),
    "project_div_zero_null": ("SELECT c_custkey, c_custkey / (c_custkey % 3) AS q, c_acctbal / (c_custkey % 2) AS f FROM customer", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey // (c_custkey % 3) END AS q, CASE WHEN c_custkey % 2 <> 0 THEN c_acctbal / (c_custkey % 2) END AS f FROM customer"),
    "project_mod_zero_null": ("SELECT c_custkey, 100 % (c_custkey % 4) AS m FROM customer", "SELECT c_custkey, 100 % nullif(c_custkey % 4, 0) AS m FROM customer"),
    "project_unary": ("SELECT c_custkey, - c_custkey AS n, ~ c_custkey AS t, + c_custkey AS p FROM customer", "SELECT c_custkey, -c_custkey AS n, ~c_custkey AS t, c_custkey AS p FROM customer"),
    "project_bitwise": ("SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 3 AS o, c_custkey ^ 5 AS x, c_custkey << 2 AS l, c_custkey >> 1 AS r FROM customer", "SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 3 AS o, xor(c_custkey, 5) AS x, c_custkey << 2 AS l, c_custkey >> 1 AS r FROM customer"),
    "project_concat_op": "SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS s, c_name || NULL AS n FROM customer",
    "project_cast_lenient": ("SELECT p_partkey, CAST(p_brand AS INTEGER) AS a, CAST('12.7' AS INTEGER) AS b, CAST(p_retailprice AS INTEGER) AS c, CAST(p_partkey AS TEXT) AS d FROM part", "SELECT p_partkey, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(trunc(p_retailprice) AS BIGINT) AS c, CAST(p_partkey AS VARCHAR) AS d FROM part"),
    "project_cast_date": ("SELECT event_id, CAST(ts AS DATE) AS d FROM events", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS d FROM events"),
    "project_interval_arith": ("SELECT o_orderkey, o_orderdate + INTERVAL '1 month' AS a, o_orderdate - INTERVAL '3 days' AS b, o_orderdate + 2 AS c FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL 3 DAY AS b, o_orderdate + INTERVAL 2 DAY AS c FROM orders"),
    "project_star_qualified": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "project_without_from": "SELECT 1 + 2 AS a, 'x' AS b, NULL IS NULL AS c",
    "values_source": "SELECT v.n AS n, v.s AS s FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(n, s) WHERE v.n > 1",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey AND o_totalprice > 450000",
    "join_full": "SELECT s_suppkey, p_partkey FROM (SELECT * FROM supplier WHERE s_suppkey < 40) s FULL OUTER JOIN (SELECT * FROM part WHERE p_partkey BETWEEN 20 AND 60) p ON s_suppkey = p_partkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_natural": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y",
    "join_using": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x LEFT JOIN (SELECT c_nationkey AS k, c_name AS b FROM customer) y USING (k)",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_theta": "SELECT r.r_regionkey, COUNT(*) AS n FROM region r JOIN nation x ON x.n_nationkey > r.r_regionkey * 4 GROUP BY r.r_regionkey",
    "join_residual": "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2.0",
    "join_multiway": "SELECT r_name, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name",
    "join_null_keys": "SELECT x.k AS k, COUNT(*) AS n FROM (SELECT NULLIF(c_nationkey, 3) AS k FROM customer) x JOIN (SELECT NULLIF(s_nationkey, 3) AS k FROM supplier) y ON x.k = y.k GROUP BY x.k",
    "join_semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "join_semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "join_anti_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_not_in_null_aware": "SELECT COUNT(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT NULLIF(s_nationkey, 1) FROM supplier)",
    "join_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    # subqueries
    "subq_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "subq_scalar_correlated_count0": "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    "subq_correlated_agg": "SELECT o_orderkey FROM orders a WHERE o_totalprice >= (SELECT MAX(b.o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)",
    "subq_exists_scalar": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS e FROM customer",
    "subq_in_tuple": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity = 1 AND l_discount = 0)",
    "subq_all_gt": ("SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 5)", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = 5)"),
    "subq_all_empty": ("SELECT COUNT(*) AS n FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 999)", "SELECT count(*) AS n FROM supplier"),
    "subq_any_lt": ("SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_custkey < 5)", "SELECT s_suppkey FROM supplier WHERE s_acctbal < (SELECT max(c_acctbal) FROM customer WHERE c_custkey < 5)"),
    "subq_eq_some": ("SELECT n_name FROM nation WHERE n_nationkey = SOME (SELECT s_nationkey FROM supplier)", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "subq_ne_all": ("SELECT c_custkey FROM customer WHERE c_custkey <> ALL (SELECT o_custkey FROM orders)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "subq_nested3": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)))",
    "subq_derived": "SELECT seg, n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS d WHERE n > 10",
    # aggregation
    "agg_global": "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_discount), 6) AS a, MIN(l_tax) AS lo, MAX(l_tax) AS hi FROM lineitem",
    "agg_global_empty": "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, MIN(l_tax) AS lo FROM lineitem WHERE l_quantity < 0",
    "agg_sum_int": ("SELECT SUM(l_linenumber) AS s, SUM(l_orderkey) AS t FROM lineitem", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(l_orderkey) AS BIGINT) AS t FROM lineitem"),
    "agg_group1": "SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag",
    "agg_group2": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(AVG(l_quantity), 4) AS a FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_group_expr": "SELECT o_custkey % 10 AS b, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10",
    "agg_group_alias": "SELECT o_custkey % 5 AS b, COUNT(*) AS n FROM orders GROUP BY b",
    "agg_group_position": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2",
    "agg_null_group": "SELECT NULLIF(o_orderstatus, 'F') AS s, COUNT(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'F')",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12 AND SUM(o_totalprice) > 1000",
    "agg_post_expr": "SELECT l_returnflag, ROUND(SUM(l_extendedprice) / COUNT(*), 4) AS per, MAX(l_tax) - MIN(l_tax) AS spread FROM lineitem GROUP BY l_returnflag",
    "agg_filter_clause": "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 200000) AS big, ROUND(SUM(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 2) AS low FROM orders GROUP BY o_orderstatus",
    "agg_count_distinct": "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, COUNT(o_custkey) AS m FROM orders GROUP BY o_orderstatus",
    "agg_sum_distinct": ("SELECT l_returnflag, SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_quantity) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_quantity) AS a FROM lineitem GROUP BY l_returnflag"),
    "agg_rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_grouping_fn": "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) AS g1, GROUPING(l_linestatus) AS g2, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)",
    "agg_first_ordered": ("SELECT o_orderstatus, FIRST(o_orderkey ORDER BY o_totalprice) AS f FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_min(o_orderkey, o_totalprice) AS f FROM orders GROUP BY o_orderstatus"),
    "agg_last_ordered": ("SELECT o_orderstatus, LAST(o_orderkey ORDER BY o_totalprice) AS f FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS f FROM orders GROUP BY o_orderstatus"),
    "agg_string_agg": "SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name DESC) AS s FROM nation GROUP BY n_regionkey",
    "agg_string_agg_distinct": "SELECT n_regionkey, STRING_AGG(DISTINCT CAST(n_regionkey AS TEXT), ',') AS s FROM nation GROUP BY n_regionkey",
    "agg_group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey"),
    "agg_array_agg": ("SELECT n_regionkey, ARRAY_AGG(n_nationkey ORDER BY n_nationkey DESC) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey DESC)) AS VARCHAR) AS s FROM nation GROUP BY n_regionkey"),
    "agg_stddev": ("SELECT l_returnflag, ROUND(STDDEV(l_quantity), 6) AS s, ROUND(STDDEV_POP(l_quantity), 6) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS p FROM lineitem GROUP BY l_returnflag"),
    "agg_stddev_samp": "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS s FROM lineitem GROUP BY l_returnflag",
    "agg_variance": ("SELECT l_returnflag, ROUND(VARIANCE(l_quantity), 5) AS s, ROUND(VAR_POP(l_quantity), 5) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(var_pop(l_quantity), 5) AS s, round(var_pop(l_quantity), 5) AS p FROM lineitem GROUP BY l_returnflag"),
    "agg_var_samp": "SELECT l_returnflag, ROUND(VAR_SAMP(l_quantity), 5) AS s FROM lineitem GROUP BY l_returnflag",
    "agg_median": "SELECT l_returnflag, MEDIAN(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag",
    "agg_min_max_text": "SELECT o_orderstatus, MIN(o_orderpriority) AS a, MAX(o_orderpriority) AS b, MIN(o_orderdate) AS c FROM orders GROUP BY o_orderstatus",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "distinct_on_star": ("SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",),
    "distinct_on_alias": ("SELECT DISTINCT ON (o_custkey) o_custkey AS c, o_totalprice * 2 AS t FROM orders ORDER BY c, t DESC",),
    "distinct_on_group_by": ("SELECT DISTINCT ON (o_orderstatus) o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority ORDER BY o_orderstatus, n DESC, o_orderpriority",),
    "distinct_on_limit": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 7",),
    "agg_first_two_keys": (
        "SELECT o_custkey, FIRST(o_orderkey ORDER BY o_orderpriority, o_totalprice DESC) AS f, LAST(o_orderkey ORDER BY o_orderstatus DESC, o_orderpriority, o_orderkey) AS l FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, first(o_orderkey ORDER BY o_orderpriority, o_totalprice DESC) AS f, last(o_orderkey ORDER BY o_orderstatus DESC, o_orderpriority, o_orderkey) AS l FROM orders GROUP BY o_custkey",
    ),
    "agg_array_two_keys": (
        "SELECT o_custkey, ARRAY_AGG(o_orderkey ORDER BY o_orderpriority DESC, o_orderkey) AS a, STRING_AGG(o_orderstatus, '' ORDER BY o_orderpriority, o_orderkey DESC) AS s FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, CAST(to_json(list(o_orderkey ORDER BY o_orderpriority DESC, o_orderkey)) AS VARCHAR) AS a, string_agg(o_orderstatus, '' ORDER BY o_orderpriority, o_orderkey DESC) AS s FROM orders GROUP BY o_custkey",
    ),
    "filter_glob_column": ("SELECT p_partkey FROM part WHERE p_brand GLOB SUBSTR(p_brand, 1, 7) || '?' AND NOT p_name GLOB LEFT(p_name, 3)", "SELECT p_partkey FROM part WHERE length(p_brand) = 8 AND length(p_name) <> 3"),
    "filter_like_number": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderkey NOT LIKE '1%' AND NOT (o_orderkey LIKE '%')", "SELECT count(*) AS n FROM orders"),
    "subq_not_in_with_null": ("SELECT COUNT(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT NULLIF(s_nationkey, 3) FROM supplier)", "SELECT count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)"),
    "subq_not_in_of_null": ("SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 4) AND NULLIF(c_nationkey, 5) NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0)", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 4)"),
    "cte_hides_table": ("WITH nation AS (SELECT 1 AS one) SELECT one FROM nation",),
    # sorting: a row number carries the order
    "sort_nulls_default": "SELECT k, ROW_NUMBER() OVER (ORDER BY k, c) AS a, ROW_NUMBER() OVER (ORDER BY k DESC NULLS FIRST, c) AS d FROM (SELECT NULLIF(c_nationkey, 4) AS k, c_custkey AS c FROM customer) x",
    "sort_nulls_first": "SELECT k, ROW_NUMBER() OVER (ORDER BY k NULLS FIRST, c) AS a, ROW_NUMBER() OVER (ORDER BY k DESC NULLS LAST, c) AS d FROM (SELECT NULLIF(c_nationkey, 4) AS k, c_custkey AS c FROM customer) x",
    "topk_multi_key": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25",
    "sort_hidden_column": "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 500",
    "limit_fetch_first": "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC FETCH FIRST 7 ROWS ONLY",
    # set operations
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 10",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_precedence": ("SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION SELECT n_nationkey FROM nation EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 20", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION (SELECT n_nationkey FROM nation EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 20)"),
    # common table expressions
    "cte_single": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey",
    "cte_multi": "WITH a(k, n) AS (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey), b AS (SELECT MAX(n) AS m FROM a) SELECT a.k AS k, a.n AS n FROM a JOIN b ON a.n = b.m",
    "cte_in_subquery": "WITH v AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM v)",
    "cte_recursive_series": ("WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 20) SELECT n, f FROM r",),
    "cte_recursive_tree": ("WITH RECURSIVE t(node, depth) AS (SELECT 0, 0 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM nation n JOIN t ON n.n_nationkey / 2 = t.node WHERE n.n_nationkey > 0) SELECT node, depth FROM t WHERE depth < 10", "WITH RECURSIVE t(node, depth) AS (SELECT 0, 0 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM nation n JOIN t ON n.n_nationkey // 2 = t.node WHERE n.n_nationkey > 0) SELECT node, depth FROM t WHERE depth < 10"),
})
