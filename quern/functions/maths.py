"""Numeric functions: integers are 64-bit, everything else is double; domain errors are NULL."""

_double = lambda x: f"CAST({x} AS DOUBLE)"


def _truncate(x: str, d: str = "0") -> str:
    p = f"power(10.0D, {d})"
    return f"CAST(CASE WHEN {x} < 0 THEN ceil({x} * {p}) / {p} ELSE floor({x} * {p}) / {p} END AS DOUBLE)"


def _log(a: str, b: str | None = None) -> str:
    """One argument: base 10; two: base, value."""
    if b is None:
        return f"log10({_double(a)})"
    return f"CASE WHEN {a} > 0 AND {a} <> 1 AND {b} > 0 THEN log({_double(a)}, {_double(b)}) END"


_ceil = lambda x: f"CAST(ceil({x}) AS DOUBLE)"
_power = lambda a, b: f"power({_double(a)}, {_double(b)})"
FUNCTIONS = {
    "ABS": lambda x: f"CASE WHEN {x} = -9223372036854775808 THEN NULL ELSE abs({x}) END",
    "ROUND": lambda x, d="0": f"round({_double(x)}, {d})",
    "FLOOR": lambda x: f"CAST(floor({x}) AS DOUBLE)",
    "CEILING": _ceil,
    "CEIL": _ceil,
    "MOD": lambda a, b: f"(({a}) % ({b}))",
    "POWER": _power,
    "POW": _power,
    "SQRT": lambda x: f"CASE WHEN {x} >= 0 THEN sqrt({_double(x)}) END",
    "LOG": _log,
    "LOG10": lambda x: f"log10({_double(x)})",
    "LOG2": lambda x: f"log2({_double(x)})",
    "LN": lambda x: f"ln({_double(x)})",
    "EXP": lambda x: f"exp({_double(x)})",
    "SIGN": lambda x: f"CAST(sign({x}) AS BIGINT)",
    "TRUNCATE": _truncate,
    "TRUNC": _truncate,
    "PI": lambda: "pi()",
    "RANDOM": lambda: "rand()",
    "SIN": lambda x: f"sin({_double(x)})",
    "COS": lambda x: f"cos({_double(x)})",
    "TAN": lambda x: f"tan({_double(x)})",
}
