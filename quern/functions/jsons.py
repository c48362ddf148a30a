"""JSON functions: documents are texts, results too; what isn't JSON is NULL."""


def _path(p: str) -> str:
    """A path literal for Spark: a bare key is $.key."""
    return p if p.startswith("'$") else f"concat('$.', {p})"


def element(x: str) -> str:
    """Any value as JSON text."""
    a = f"to_json(array({x}))"
    return f"substring({a}, 2, length({a}) - 2)"


def _type(j: str, path: str = "'$'") -> str:
    s = f"schema_of_variant(variant_get(try_parse_json({j}), {path}))"
    return f"CASE WHEN {s} LIKE 'OBJECT%' THEN 'object' WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN {s} = 'STRING' THEN 'string' WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} = 'VOID' THEN 'null' WHEN {s} IS NOT NULL THEN 'number' END"


def _object(*kv: str) -> str:
    if len(kv) % 2:
        raise ValueError("JSON_OBJECT takes keys and values")
    pairs = ", ".join(f"concat({element(f'CAST({k} AS STRING)')}, ':', {element(v)})" for k, v in zip(kv[::2], kv[1::2], strict=True))
    return f"concat('{{', concat_ws(',', {pairs}), '}}')" if kv else "'{}'"


FUNCTIONS = {
    "JSON_EXTRACT": lambda j, p: f"get_json_object({j}, {_path(p)})",
    "JSON_ARRAY_LENGTH": lambda j, p=None: f"CAST(json_array_length({j if p is None else f'get_json_object({j}, {_path(p)})'}) AS BIGINT)",
    "JSON_ARRAY": lambda *a: f"concat('[', concat_ws(',', {', '.join(map(element, a))}), ']')" if a else "'[]'",
    "JSON_OBJECT": _object,
    "JSON_TYPE": _type,
    "JSON_TYPEOF": _type,
    "JSON_VALID": lambda x: f"CASE WHEN ({x}) IS NULL THEN NULL WHEN try_parse_json({x}) IS NOT NULL THEN 1L ELSE 0L END",
    "JSON_KEYS": lambda j: f"to_json(json_object_keys({j}))",
}
