"""Dates and times: every one is a timestamp in UTC; texts are parsed, NULL if they can't be."""

import re

#: Units of DATE_TRUNC, fields of EXTRACT, and format tokens of TO_CHAR in the order they are replaced.
TRUNC_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
TOKENS = (("YYYY", "yyyy"), ("YY", "yy"), ("MONTH", "MMMM"), ("MON", "MMM"), ("MM", "MM"), ("DAY", "EEEE"), ("DY", "EEE"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "HH"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("AM", "a"), ("PM", "a"), ("TZ", "'UTC'"))
DURATIONS = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def moment(x: str) -> str:
    return f"CAST({x} AS TIMESTAMP)"


def _literal(x: str) -> str:
    if len(x) < 2 or x[0] != "'" or x[-1] != "'":
        raise ValueError(f"a literal is needed here, not {x}")
    return x[1:-1].replace("''", "'")


def duration_micros(text: str) -> int:
    """Microseconds of a duration such as 15m, 1h30m or 500ms."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text}")
    n = round(sum(float(a) * DURATIONS[b] for a, b in parts))
    if n < 1:
        raise ValueError(f"not a duration of at least a microsecond: {text}")
    return n


def _date_trunc(unit: str, ts: str) -> str:
    if (u := _literal(unit).lower()) not in TRUNC_UNITS:
        raise ValueError(f"DATE_TRUNC has no unit {u}")
    return f"date_trunc('{u}', {moment(ts)})"


def _time_trunc(width: str, ts: str) -> str:
    n = duration_micros(_literal(width))
    m = f"unix_micros({moment(ts)})"
    return f"timestamp_micros({m} - {m} % {n})"


def extract(field: str, ts: str) -> str:
    ts, field = moment(ts), field.lower()
    by_hand = {
        "dow": f"dayofweek({ts}) - 1",
        "isodow": f"weekday({ts}) + 1",
        "doy": f"dayofyear({ts})",
        "second": f"second({ts})",
        "millisecond": f"pmod(unix_micros({ts}) DIV 1000, 1000)",
        "microsecond": f"pmod(unix_micros({ts}), 1000000)",
        "epoch": f"floor(unix_micros({ts}) / 1000000)",
        "week": f"weekofyear({ts})",
    }
    if field not in by_hand and field not in ("year", "quarter", "month", "day", "hour", "minute"):
        raise ValueError(f"EXTRACT has no field {field}")
    return f"CAST({by_hand.get(field) or f'extract({field} FROM {ts})'} AS BIGINT)"


def _add(sign: str):
    def add(ts: str, n: str, unit: str = "'day'") -> str:
        u, at = _literal(unit).upper().rstrip("S"), moment(ts)
        if u in ("YEAR", "MONTH"):  # these go by whole seconds
            at = f"date_trunc('second', {at})"
        return f"timestampadd({u}, CAST({sign}({n}) AS INT), {at})"

    return add


def _datediff(a: str, b: str) -> str:
    """Whole elapsed days, not midnights."""
    return f"((unix_micros({moment(a)}) - unix_micros({moment(b)})) DIV 86400000000)"


def _to_char(x: str, fmt: str) -> str:
    f = _literal(fmt)
    if re.fullmatch(r"[09,.$ ]+", f):
        places = len(f.partition(".")[2])
        plain = f"format_number(CAST({x} AS DOUBLE), {places})"
        return plain if "," in f else f"replace({plain}, ',', '')"
    out, i = "", 0
    while i < len(f):
        for token, java in TOKENS:
            if f.startswith(token, i):
                part = f"date_format({moment(x)}, '{java}')" if java != "'UTC'" else "'UTC'"
                out += f", upper({part})" if token in ("MONTH", "MON", "DAY", "DY", "AM", "PM") else f", {part}"
                i += len(token)
                break
        else:
            out += ", '" + f[i].replace("'", "\\'") + "'"
            i += 1
    return f"concat({out[2:]})" if out else "''"


_field = lambda f: lambda ts: extract(f, ts)
FUNCTIONS = {
    "NOW": lambda: "current_timestamp()",
    "CURRENT_TIMESTAMP": lambda: "current_timestamp()",
    "CURRENT_DATE": lambda: "date_trunc('day', current_timestamp())",
    "CURRENT_TIME": lambda: "date_format(current_timestamp(), 'HH:mm:ss')",
    "DATE_TRUNC": _date_trunc,
    "TIME_TRUNC": _time_trunc,
    "EXTRACT": lambda field, ts: extract(_literal(field), ts),
    "YEAR": _field("year"),
    "MONTH": _field("month"),
    "DAY": _field("day"),
    "HOUR": _field("hour"),
    "MINUTE": _field("minute"),
    "SECOND": _field("second"),
    "DATE_ADD": _add(""),
    "DATE_SUB": _add("-"),
    "DATEDIFF": _datediff,
    "DATE_DIFF": _datediff,
    "TO_CHAR": _to_char,
}
