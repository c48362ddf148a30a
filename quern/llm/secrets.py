"""Secrets in texts, in DataFrame expressions only.

Patterns mark what has a telling form: assignments, access keys, long hexadecimal runs. Strings that could
be a secret without one are then judged by Shannon entropy: a window slides over the string, its counts of
characters are kept up as one comes in and one goes out, and so is the sum of n log2 n from which the
window's entropy follows. Each character class has a window and a threshold, and an allow-list suppresses
identifiers and placeholders.

Positions come from splitting the text at its marked matches and adding up lengths, in chunks, so that a text
with very many matches costs no more than it is long.

Defined results: null texts are empty; empty texts have no spans; repeated rows give equal rows; code points
U+0001 and U+0003 in a text count as U+0002, which no pattern holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, with the lengths below which a match is dropped. In order of kind.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "entropy")
#: Strings judged by entropy, and the allow-list of what is none: identifiers, digests by name, placeholders, runs.
#: Letters are no identifier if small ones stand alone between capitals twice.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOWED = r"(?i)^(?:(?!(?-i:(?:.*?[A-Z][a-z](?=[A-Z])){2}))(?:[^0-9]+|[a-z/_-]+[0-9]{0,8})|[0-9_/=-]+|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|.*(?:example|sample|dummy|placeholder|xxxx|0123456|abcdefg).*)$"
#: By character class: what the string consists of, window, bits of entropy from which it is a secret.
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+$", 16, 2.9),
    ("alphanumeric", r"^[0-9A-Za-z]+$", 20, 3.6),
    ("base64", r"^[0-9A-Za-z+/_=-]+$", 20, 3.8),
)
#: The characters that candidates consist of; a character's place is its count's.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
_MARK, _INNER, _PLAIN = "\x01", "\x03", "\x02"
_CHUNK = 256


def _marked(text: Column, pattern: str, inner: str = "") -> Column:
    """The text in parts: matches, each followed by _INNER and `inner`, and what is between them."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_INNER}{inner}{_MARK}"), _MARK, -1)


def _spans(parts: Column, kind: int, keep) -> Column:
    """Structs (start, kind, end, value) of the matches among the parts that `keep(value, inner)` keeps."""

    def of_chunk(c: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("spans"))

        def step(state: Column, part: Column) -> Column:
            value = F.substring_index(part, _INNER, 1)
            is_match = F.contains(part, F.lit(_INNER))
            end = state["at"] + F.length(value)
            inner = F.substring_index(part, _INNER, -1)
            span = F.array(F.struct(state["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")))
            spans = F.when(is_match & keep(value, inner), F.concat(state["spans"], span)).otherwise(state["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        return F.aggregate(F.slice(parts, c * _CHUNK + 1, F.lit(_CHUNK)), start, step)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _CHUNK).cast("int")), of_chunk)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("spans"))

    def move(state: Column, chunk: Column) -> Column:
        moved = F.transform(chunk["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + state["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((state["at"] + chunk["at"]).alias("at"), F.concat(state["spans"], moved).alias("spans"))

    return F.when(F.size(parts) > 1, F.aggregate(chunks, none, move)["spans"]).otherwise(none["spans"])


def _nlogn(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(0.0)


def window_entropy(value: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits, of a window of so many characters; shorter strings have 0."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # the codes travel in the state: in a lambda they would be made again at each step
    start = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(state: Column, i: Column) -> Column:
        come, go = F.get(state["codes"], i), F.coalesce(F.get(state["codes"], i - window), F.lit(0))
        a, b = F.get(state["counts"], come - 1), F.coalesce(F.get(state["counts"], go - 1), F.lit(0))
        same = come == go
        total = F.when(same, state["sum"]).otherwise(state["sum"] + _nlogn(a + 1) - _nlogn(a) + F.when(go > 0, _nlogn(b - 1) - _nlogn(b)).otherwise(0.0))
        counts = F.when(same, state["counts"]).otherwise(F.transform(state["counts"], lambda n, k: n + (k == come - 1).cast("int") - (k == go - 1).cast("int")))
        bits = F.when(i >= window - 1, F.log2(F.lit(float(window))) - total / window).otherwise(0.0)
        return F.struct(state["codes"].alias("codes"), counts.alias("counts"), total.alias("sum"), F.greatest(state["best"], bits).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), start, step)["best"]


def _high(value: Column, _: Column) -> Column:
    """Whether a candidate is no allowed string and high in entropy for its class."""
    rule = F.lit(False)
    for _, chars, window, least in reversed(CLASSES):
        rule = F.when(value.rlike(chars), window_entropy(value, window) >= least).otherwise(rule)
    return ~value.rlike(ALLOWED) & rule


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `secrets`: structs (start, kind, end, value), by start and kind; entropy spans meet no other span. A column of that name is replaced."""
    plain = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), _MARK + _INNER, _PLAIN * 2)
    every = F.lit(True)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "secrets"]
    kept = docs.select(F.struct(*others).alias("row"), plain.alias("t"))
    kept = kept.select("row", _marked(F.col("t"), ASSIGN, "$2").alias("p0"), _marked(F.col("t"), ACCESS).alias("p1"), _marked(F.col("t"), HEX).alias("p2"), _marked(F.col("t"), CANDIDATE).alias("p3"))
    kept = kept.select(
        "row",
        _spans(F.col("p0"), 0, lambda v, inner: F.length(inner) >= ASSIGN_LEAST).alias("s0"),
        _spans(F.col("p1"), 1, lambda v, inner: every).alias("s1"),
        _spans(F.col("p2"), 2, lambda v, inner: every).alias("s2"),
        _spans(F.col("p3"), 3, _high).alias("s3"),
    )
    base = F.concat("s0", "s1", "s2")
    kept = kept.select("row", base.alias("base"), "s3")
    alone = F.filter("s3", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return kept.select("row", F.array_sort(F.concat("base", alone)).alias("found")).select("row.*", F.col("found").alias("secrets"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
