"""One query for each scalar function."""

from quern.queries import statements


def _of(table: str, key: str, exprs: str, oracle: str | None = None, where: str = ""):
    tail = f" FROM {table}{' WHERE ' + where if where else ''}"
    return (f"SELECT {key}, {exprs}{tail}", f"SELECT {key}, {oracle or exprs}{tail}")


def _part(exprs: str, oracle: str | None = None):
    return _of("part", "p_partkey", exprs, oracle)


def _customer(exprs: str, oracle: str | None = None):
    return _of("customer", "c_custkey", exprs, oracle)


def _events(exprs: str, oracle: str | None = None):
    return _of("events", "event_id", exprs, oracle)


_MANY = "(VALUES (1, '  a b '), (2, 'é東🙂'), (3, ''), (4, NULL)) AS v(n, s)"


def _texts(exprs: str, oracle: str | None = None):
    return _of(_MANY, "n", exprs, oracle)


_field = lambda f, o=None: _events(f"EXTRACT({f} FROM ts) AS x", o or f"CAST(extract({f} FROM ts) AS BIGINT) AS x")
_call = lambda f, o=None: _events(f"{f}(ts) AS x", f"CAST({o or f.lower()}(ts) AS BIGINT) AS x")
_trunc = lambda u: _events(f"DATE_TRUNC('{u}', ts) AS x", f"date_trunc('{u}', ts)::TIMESTAMP AS x")

statements({
    # strings
    "str_upper": _part("UPPER(p_name) AS x"),
    "str_lower": _part("LOWER(p_type) AS x"),
    "str_length": _texts("LENGTH(s) AS x"),
    "str_char_length": _texts("CHAR_LENGTH(s) AS x", "length(s) AS x"),
    "str_char": _part("CHAR(65 + p_size % 26) AS x, CHAR(233) AS y, CHAR(128578) AS z, CHAR(-1) AS w", "chr(CAST(65 + p_size % 26 AS INTEGER)) AS x, chr(233) AS y, chr(128578) AS z, NULL::VARCHAR AS w"),
    "str_concat": _texts("CONCAT(s, '-', NULL, n) AS x"),
    "str_concat_ws": _texts("CONCAT_WS('/', s, NULL, n) AS x, CONCAT_WS(NULL, s, 'a') AS y"),
    "str_substring": _part("SUBSTRING(p_name, 2, 4) AS x, SUBSTRING(p_name, 3) AS y, SUBSTRING(p_name, 0, 3) AS z", "substring(p_name, 2, 4) AS x, substring(p_name, 3) AS y, substring(p_name, 1, 3) AS z"),
    "str_substr": _part("SUBSTR(p_name, -5, 2) AS x, SUBSTR(p_name, 100) AS y", "substring(p_name, 1, 2) AS x, substring(p_name, 100) AS y"),
    "str_trim": _texts("TRIM(s) AS x"),
    "str_ltrim": _texts("LTRIM(s) AS x"),
    "str_rtrim": _texts("RTRIM(s) AS x"),
    "str_replace": _part("REPLACE(p_name, 'e', 'E.') AS x"),
    "str_reverse": _texts("REVERSE(s) AS x"),
    "str_left": _part("LEFT(p_name, 3) AS x, LEFT(p_name, -1) AS y", "left(p_name, 3) AS x, '' AS y"),
    "str_right": _part("RIGHT(p_name, 3) AS x, RIGHT(p_name, -1) AS y", "right(p_name, 3) AS x, '' AS y"),
    "str_repeat": _part("REPEAT(p_type, 2) AS x, REPEAT(p_type, -1) AS y", "repeat(p_type, 2) AS x, '' AS y"),
    "str_split_part": _part("SPLIT_PART(p_name, ' ', 1) AS x, SPLIT_PART(p_name, ' ', 9) AS y"),
    "str_starts_with": _part("STARTS_WITH(p_name, 'red') AS x"),
    "str_ends_with": _part("ENDS_WITH(p_name, 'ring') AS x"),
    "str_contains": _part("CONTAINS(p_name, 'll') AS x"),
    "str_position": _part("POSITION('r' IN p_name) AS x, POSITION('zz', p_name) AS y", "CAST(position('r' IN p_name) AS BIGINT) AS x, CAST(strpos(p_name, 'zz') AS BIGINT) AS y"),
    "str_strpos": _part("STRPOS(p_name, 'r') AS x", "CAST(strpos(p_name, 'r') AS BIGINT) AS x"),
    "str_instr": _part("INSTR(p_name, 'r') AS x", "CAST(instr(p_name, 'r') AS BIGINT) AS x"),
    "str_locate": _part("LOCATE('r', p_name) AS x, LOCATE('r', p_name, 4) AS y", "CAST(strpos(p_name, 'r') AS BIGINT) AS x, CAST(CASE WHEN strpos(substring(p_name, 4), 'r') > 0 THEN strpos(substring(p_name, 4), 'r') + 3 ELSE 0 END AS BIGINT) AS y"),
    "str_lpad": _part("LPAD(p_name, 14, '*') AS x, LPAD(p_name, 3) AS y", "lpad(p_name, 14, '*') AS x, lpad(p_name, 3, ' ') AS y"),
    "str_rpad": _part("RPAD(p_name, 14, '*') AS x, RPAD(p_name, 3) AS y", "rpad(p_name, 14, '*') AS x, rpad(p_name, 3, ' ') AS y"),
    # numbers
    "math_abs": _customer("ABS(c_acctbal) AS x, ABS(0 - c_custkey) AS y"),
    "math_round": _customer("ROUND(c_acctbal / 3.0, 2) AS x, ROUND(c_acctbal) AS y", "round(c_acctbal / 3.0::DOUBLE, 2) AS x, round(c_acctbal) AS y"),
    "math_floor": _customer("FLOOR(c_acctbal / 7.0) AS x", "floor(c_acctbal / 7.0::DOUBLE) AS x"),
    "math_ceiling": _customer("CEILING(c_acctbal / 7.0) AS x", "ceil(c_acctbal / 7.0::DOUBLE) + 0 AS x"),
    "math_ceil": _customer("CEIL(c_acctbal) AS x", "ceil(c_acctbal) + 0 AS x"),
    "math_mod": _customer("MOD(c_custkey, 7) AS x", "c_custkey % 7 AS x"),
    "math_power": _customer("POWER(c_nationkey, 3) AS x", "power(c_nationkey::DOUBLE, 3) AS x"),
    "math_pow": _customer("POW(2, c_nationkey) AS x", "power(2::DOUBLE, c_nationkey) AS x"),
    "math_sqrt": _customer("ROUND(SQRT(c_acctbal), 8) AS x", "CASE WHEN c_acctbal >= 0 THEN round(sqrt(greatest(c_acctbal, 0)), 8) END AS x"),
    "math_log": _customer("ROUND(LOG(c_custkey), 8) AS x, ROUND(LOG(2, c_custkey), 8) AS y, LOG(1, c_custkey) AS z", "CASE WHEN c_custkey > 0 THEN round(log10(greatest(c_custkey, 1)), 8) END AS x, CASE WHEN c_custkey > 0 THEN round(ln(greatest(c_custkey, 1)) / ln(2), 8) END AS y, NULL::DOUBLE AS z"),
    "math_log10": _customer("ROUND(LOG10(c_custkey), 8) AS x", "CASE WHEN c_custkey > 0 THEN round(log10(greatest(c_custkey, 1)), 8) END AS x"),
    "math_log2": _customer("ROUND(LOG2(c_custkey), 8) AS x", "CASE WHEN c_custkey > 0 THEN round(log2(greatest(c_custkey, 1)), 8) END AS x"),
    "math_ln": _customer("ROUND(LN(c_custkey), 8) AS x", "CASE WHEN c_custkey > 0 THEN round(ln(greatest(c_custkey, 1)), 8) END AS x"),
    "math_exp": _customer("ROUND(EXP(c_nationkey / 10.0), 6) AS x", "round(exp(c_nationkey / 10.0::DOUBLE), 6) AS x"),
    "math_sign": _customer("SIGN(c_acctbal) AS x, SIGN(0) AS y", "CAST(sign(c_acctbal) AS BIGINT) AS x, 0::BIGINT AS y"),
    "math_truncate": _customer("TRUNCATE(c_acctbal, 1) AS x, TRUNCATE(0 - c_acctbal) AS y", "trunc(c_acctbal * 10) / 10 + 0 AS x, trunc(0 - c_acctbal) + 0 AS y"),
    "math_trunc": _customer("TRUNC(c_acctbal) AS x", "trunc(c_acctbal) + 0 AS x"),
    "math_pi": "SELECT PI() AS x",
    "math_sin": _customer("ROUND(SIN(c_custkey), 9) AS x"),
    "math_cos": _customer("ROUND(COS(c_custkey), 9) AS x"),
    "math_tan": _customer("ROUND(TAN(c_custkey), 6) AS x"),
    # dates and times
    **{f"dt_date_trunc_{u}": _trunc(u) for u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")},
    "dt_time_trunc": _events("TIME_TRUNC('15m', ts) AS x, TIME_TRUNC('1h30m', ts) AS y, TIME_TRUNC('7m', ts) AS z", "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS x, time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '1970-01-01') AS y, time_bucket(INTERVAL 7 MINUTE, ts, TIMESTAMP '1970-01-01') AS z"),
    **{f"dt_extract_{f}": _field(f) for f in ("year", "quarter", "month", "week", "day", "hour", "minute", "dow", "isodow", "doy")},
    "dt_extract_second": _field("second", "CAST(floor(extract(second FROM ts)) AS BIGINT) AS x"),
    "dt_extract_millisecond": _field("millisecond", "CAST((epoch_us(ts) // 1000) % 1000 AS BIGINT) AS x"),
    "dt_extract_microsecond": _field("microsecond", "CAST(epoch_us(ts) % 1000000 AS BIGINT) AS x"),
    "dt_extract_epoch": _field("epoch", "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS x"),
    **{f"dt_{f.lower()}": _call(f) for f in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")},
    "dt_date_add": _events("DATE_ADD(ts, 3) AS x, DATE_ADD(ts, 2, 'hour') AS y, DATE_ADD(DATE_TRUNC('day', ts), 1, 'month') AS z", "ts + INTERVAL 3 DAY AS x, ts + INTERVAL 2 HOUR AS y, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 MONTH AS z"),
    "dt_date_sub": _events("DATE_SUB(ts, 3) AS x, DATE_SUB(ts, 90, 'minute') AS y", "ts - INTERVAL 3 DAY AS x, ts - INTERVAL 90 MINUTE AS y"),
    "dt_datediff": _of("orders", "o_orderkey", "DATEDIFF(TIMESTAMP '2000-01-01 12:00:00', o_orderdate) AS x, DATE_DIFF(o_orderdate, TIMESTAMP '1995-06-01') AS y", "date_sub('day', o_orderdate, TIMESTAMP '2000-01-01 12:00:00') AS x, date_sub('day', TIMESTAMP '1995-06-01', o_orderdate) AS y"),
    "dt_to_char": _events("TO_CHAR(ts, 'YYYY-MM-DD HH24:MI:SS') AS x, TO_CHAR(ts, 'DD MON YY') AS y, TO_CHAR(value, '9,999.99') AS z", "strftime(ts, '%Y-%m-%d %H:%M:%S') AS x, upper(strftime(ts, '%d %b %y')) AS y, format('{:,.2f}', value) AS z"),
    # conditions
    "cond_coalesce": _customer("COALESCE(NULLIF(c_nationkey, 3), -1) AS x"),
    "cond_nullif": _customer("NULLIF(c_mktsegment, 'BUILDING') AS x"),
    "cond_ifnull": _customer("IFNULL(NULLIF(c_nationkey, 3), 100) AS x"),
    "cond_greatest": _customer("GREATEST(c_nationkey, 10, NULLIF(c_nationkey, 3)) AS x", "CASE WHEN c_nationkey = 3 THEN NULL ELSE greatest(c_nationkey, 10) END AS x"),
    "cond_least": _customer("LEAST(c_nationkey, 10, NULLIF(c_nationkey, 3)) AS x", "CASE WHEN c_nationkey = 3 THEN NULL ELSE least(c_nationkey, 10) END AS x"),
    "cond_iif": _customer("IIF(c_acctbal > 0, 'plus', 'minus') AS x", "CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS x"),
    "cond_typeof": _customer("TYPEOF(c_custkey) AS a, TYPEOF(c_acctbal) AS b, TYPEOF(c_name) AS c, TYPEOF(NULLIF(c_nationkey, 3)) AS d, TYPEOF(c_acctbal > 0) AS e", "'INTEGER' AS a, 'FLOAT' AS b, 'TEXT' AS c, CASE WHEN c_nationkey = 3 THEN 'NULL' ELSE 'INTEGER' END AS d, 'BOOLEAN' AS e"),
    "cond_collate": _of("(VALUES (1, 'Ärger'), (2, 'ABC'), (3, 'déjà')) AS v(n, s)", "n", "COLLATE(s, 'NOCASE') AS x, COLLATE(s, 'NOACCENT') AS y, COLLATE(s, 'BINARY') AS z", "lower(s) AS x, strip_accents(s) AS y, s AS z"),
    "cond_iif_truthy": _customer("IIF(c_nationkey, 'a', 'b') AS x, IIF(NULL, 1, 2) AS y, IIF('false', 1, 2) AS z", "CASE WHEN c_nationkey <> 0 THEN 'a' ELSE 'b' END AS x, 2 AS y, 2 AS z"),
    "cond_cast_function": _customer("CAST(c_custkey, 'TEXT') AS x", "CAST(c_custkey AS TEXT) AS x"),
    "cond_now": ("SELECT NOW() >= CURRENT_DATE AND CURRENT_TIMESTAMP >= CURRENT_DATE AND LENGTH(CURRENT_TIME) = 8 AS x, VERSION() <> '' AS y, RANDOM() BETWEEN 0 AND 1 AS z", "SELECT true AS x, true AS y, true AS z"),
    "math_negate_least": ("SELECT -(0 - 9223372036854775807 - 1) AS x, -(0 - 5) AS y", "SELECT NULL::BIGINT AS x, 5::BIGINT AS y"),
    "dt_add_month_whole_seconds": ("SELECT DATE_ADD(TIMESTAMP '2024-01-31 10:00:00.5', 1, 'month') AS x, DATE_ADD(TIMESTAMP '2024-01-31 10:00:00.5', 1, 'day') AS y", "SELECT TIMESTAMP '2024-02-29 10:00:00' AS x, TIMESTAMP '2024-02-01 10:00:00.5' AS y"),
    # JSON
    "json_extract": _events("JSON_EXTRACT(props, '$.k') AS x, JSON_EXTRACT(props, '$.none') AS y", "json_extract_string(props, '$.k') AS x, NULL::VARCHAR AS y"),
    "json_arrow": _events("props -> 'k' AS x, props ->> 'k' AS y", "json_extract_string(props, '$.k') AS x, json_extract_string(props, '$.k') AS y"),
    "json_index": _of("(VALUES (1, '[10, 20]'), (2, '[{\"a\": 5}]')) AS v(n, j)", "n", "j -> 0 AS x, j[0] -> 'a' AS y", "CASE n WHEN 1 THEN '10' ELSE '{\"a\":5}' END AS x, CASE n WHEN 2 THEN '5' END AS y"),
    "json_array_length": _of("(VALUES (1, '[1,2,3]'), (2, '{}'), (3, '[]')) AS v(n, j)", "n", "JSON_ARRAY_LENGTH(j) AS x", "CASE n WHEN 1 THEN 3 WHEN 3 THEN 0 END::BIGINT AS x"),
    "json_array": _customer("JSON_ARRAY(c_custkey, c_mktsegment, NULL) AS x", "'[' || c_custkey || ',\"' || c_mktsegment || '\",null]' AS x"),
    "json_object": _customer("JSON_OBJECT('k', c_custkey, 's', c_mktsegment) AS x", "'{\"k\":' || c_custkey || ',\"s\":\"' || c_mktsegment || '\"}' AS x"),
    "json_type": _of("(VALUES (1, '[1]'), (2, '{}'), (3, '\"s\"'), (4, '1.5'), (5, 'true'), (6, 'null'), (7, 'no json')) AS v(n, j)", "n", "JSON_TYPE(j) AS x, JSON_TYPEOF(j) AS y", "CASE n WHEN 1 THEN 'array' WHEN 2 THEN 'object' WHEN 3 THEN 'string' WHEN 4 THEN 'number' WHEN 5 THEN 'boolean' WHEN 6 THEN 'null' END AS x, CASE n WHEN 1 THEN 'array' WHEN 2 THEN 'object' WHEN 3 THEN 'string' WHEN 4 THEN 'number' WHEN 5 THEN 'boolean' WHEN 6 THEN 'null' END AS y"),
    "json_valid": _events("JSON_VALID(props) AS x, JSON_VALID('nope') AS y, JSON_VALID(NULL) AS z", "CAST(json_valid(props) AS BIGINT) AS x, 0::BIGINT AS y, NULL::BIGINT AS z"),
    "json_keys": _events("JSON_KEYS(props) AS x", "CAST(to_json(json_keys(props)) AS VARCHAR) AS x"),
    # hashes
    "hash_md5": _customer("MD5(c_name) AS x", "md5(c_name) AS x"),
    "hash_sha1": _customer("SHA1(c_name) AS x", "sha1(c_name) AS x"),
    "hash_sha256": _customer("SHA256(c_name) AS x", "sha256(c_name) AS x"),
    "hash_sha384": ("SELECT SHA384('abc') AS x", "SELECT 'cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7' AS x"),
    "hash_sha512": ("SELECT SHA512('abc') AS x", "SELECT 'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f' AS x"),
    "hash_crc32": ("SELECT CRC32('123456789') AS x", "SELECT 3421780262::BIGINT AS x"),
})
