"""Conditional and conversion functions."""

#: Names that TYPEOF gives.
_TYPES = (("bigint", "INTEGER"), ("int", "INTEGER"), ("smallint", "INTEGER"), ("tinyint", "INTEGER"), ("double", "FLOAT"), ("float", "FLOAT"), ("string", "TEXT"), ("boolean", "BOOLEAN"), ("timestamp", "TIMESTAMP"), ("timestamp_ntz", "TIMESTAMP"), ("date", "TIMESTAMP"), ("variant", "JSON"))


def _all_or_null(name: str):
    """NULL if any argument is."""
    return lambda *a: f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE {name}({', '.join(a)}) END" if len(a) > 1 else a[0]


def _typeof(x: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES)
    return f"CASE WHEN ({x}) IS NULL THEN 'NULL' ELSE CASE typeof({x}) {cases} ELSE CASE WHEN typeof({x}) LIKE 'decimal%' THEN 'FLOAT' WHEN typeof({x}) LIKE 'array%' THEN 'VECTOR' ELSE 'TEXT' END END END"


#: Accented letters and what NOACCENT compares them as.
_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def _collate(x: str, name: str) -> str:
    name = name.strip("'").upper()
    if name in ("NOCASE", "CASE_INSENSITIVE"):
        return f"lower({x})"
    if name in ("NOACCENT", "ACCENT_INSENSITIVE"):
        return f"translate({x}, '{_ACCENTED}', '{_PLAIN}')"
    if name in ("BINARY", "NUMERIC"):
        return x
    raise ValueError(f"no collation {name}")


FUNCTIONS = {
    "COALESCE": lambda *a: f"coalesce({', '.join(a)})",
    "NULLIF": lambda a, b: f"nullif({a}, {b})",
    "IFNULL": lambda a, b: f"coalesce({a}, {b})",
    "GREATEST": _all_or_null("greatest"),
    "LEAST": _all_or_null("least"),
    "IIF": lambda c, a, b: f"CASE WHEN {c} THEN {a} ELSE {b} END",
    "TYPEOF": _typeof,
    "COLLATE": _collate,
    "VERSION": lambda: "'quern 0.1'",
}
