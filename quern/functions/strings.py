"""String functions: characters are code points, numbers are taken as their text."""


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _char(n: str) -> str:
    n = f"CAST({n} AS BIGINT)"
    return f"CASE WHEN {n} < 0 OR {n} > 1114111 THEN NULL WHEN {n} < 128 THEN char({n}) ELSE decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') END"


def _substring(s: str, start: str, length: str | None = None) -> str:
    """A start below 1 counts as 1 and does not shorten the length."""
    start = f"CASE WHEN {start} < 1 THEN 1 ELSE {start} END"
    if length is None:
        return f"substring({text(s)}, CAST({start} AS INT))"
    return f"substring({text(s)}, CAST({start} AS INT), CAST(CASE WHEN {length} < 0 THEN 0 ELSE {length} END AS INT))"


def _strip(pattern: str):
    return lambda s: f"regexp_replace({text(s)}, '{pattern}', '')"


def _split_part(s: str, d: str, n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN raise_error('SPLIT_PART takes positions from 1') ELSE split_part({text(s)}, {d}, CAST({n} AS INT)) END"


def _find(sub: str, s: str, start: str = "1") -> str:
    return f"CAST(locate({sub}, {text(s)}, CAST(CASE WHEN {start} < 1 THEN 1 ELSE {start} END AS INT)) AS BIGINT)"


def _pad(side: str):
    return lambda s, n, fill="' '": f"{side}({text(s)}, CAST(CASE WHEN {n} < 0 THEN 0 ELSE {n} END AS INT), {fill})"


_SPACE = "[\\\\s\\\\p{Z}\\\\x{85}]+"
_length = lambda s: f"CAST(length({text(s)}) AS BIGINT)"
FUNCTIONS = {
    "UPPER": lambda s: f"upper({text(s)})",
    "LOWER": lambda s: f"lower({text(s)})",
    "LENGTH": _length,
    "CHAR_LENGTH": _length,
    "CHAR": _char,
    "CONCAT": lambda *a: f"concat_ws('', {', '.join(map(text, a))})",
    "CONCAT_WS": lambda sep, *a: f"concat_ws({sep}, {', '.join(map(text, a))})",
    "SUBSTRING": _substring,
    "SUBSTR": _substring,
    "TRIM": _strip(f"^{_SPACE}|{_SPACE}$"),
    "LTRIM": _strip(f"^{_SPACE}"),
    "RTRIM": _strip(f"{_SPACE}$"),
    "REPLACE": lambda s, a, b: f"CASE WHEN {a} = '' THEN regexp_replace({text(s)}, '', {b}) ELSE replace({text(s)}, {a}, {b}) END",
    "REVERSE": lambda s: f"reverse({text(s)})",
    "LEFT": lambda s, n: f"left({text(s)}, CAST({n} AS INT))",
    "RIGHT": lambda s, n: f"right({text(s)}, CAST({n} AS INT))",
    "REPEAT": lambda s, n: f"CASE WHEN length({text(s)}) * {n} > 10485760 THEN raise_error('REPEAT gives more than 10 MiB') ELSE repeat({text(s)}, CAST({n} AS INT)) END",
    "SPLIT_PART": _split_part,
    "STARTS_WITH": lambda s, p: f"startswith({text(s)}, {p})",
    "ENDS_WITH": lambda s, p: f"endswith({text(s)}, {p})",
    "CONTAINS": lambda s, p: f"contains({text(s)}, {p})",
    "POSITION": lambda sub, s: _find(sub, s),
    "STRPOS": lambda s, sub: _find(sub, s),
    "INSTR": lambda s, sub: _find(sub, s),
    "LOCATE": _find,
    "LPAD": _pad("lpad"),
    "RPAD": _pad("rpad"),
}
