"""Vector functions over arrays of floats, or their text; sums are in doubles; dimensions must agree."""


def vector(x: str) -> str:
    """A literal's text as an array."""
    return f"from_json({x}, 'array<double>')" if x.startswith("'") else x


def _fold(a: str, b: str, term: str, finish: str = "s") -> str:
    a, b = vector(a), vector(b)
    same = f"CASE WHEN size({a}) <> size({b}) THEN raise_error('vectors of different dimensions') ELSE "
    return f"{same}aggregate(zip_with({a}, {b}, (x, y) -> {term}), 0D, (s, t) -> s + t, s -> {finish}) END"


_product = "CAST(x AS DOUBLE) * CAST(y AS DOUBLE)"


def l2(a: str, b: str) -> str:
    return _fold(a, b, "(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))", "sqrt(s)")


def norm(a: str) -> str:
    return f"aggregate({vector(a)}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE), s -> sqrt(s))"


def _cosine(a: str, b: str) -> str:
    d = f"({norm(a)} * {norm(b)})"
    return f"CASE WHEN {d} = 0 THEN 1D ELSE greatest(1D - {_fold(a, b, _product)} / {d}, 0D) END"


FUNCTIONS = {
    "VEC_DISTANCE_L2": l2,
    "VEC_DISTANCE_COSINE": _cosine,
    "VEC_DISTANCE_IP": lambda a, b: _fold(a, b, _product, "-s"),
    "VEC_DIMS": lambda a: f"CAST(size({vector(a)}) AS BIGINT)",
    "VEC_NORM": norm,
    "VEC_TO_TEXT": lambda a: f"concat('[', array_join({vector(a)}, ', '), ']')",
}
