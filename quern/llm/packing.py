"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most `room` tokens. Only the number of pieces of each length matters for
the plan, so the plan is made over at most `room` counts, whatever the number of documents: tables
of the lengths in stock and of the sums of their pairs find every one, two or three that fill what a
longest piece leaves exactly; as many sequences are made of a combination as its counts allow. What has
no exact complement goes, longest first, into the fullest open sequence with room for it. Taking all exact
fillings first, or along with best fit, wins on different stocks: the plan of fewest sequences is taken.

Pieces then take the places of their length in order of a hash, by a rank within (length, salt) and the
salt's offset: no length, however common, lands in one task.

Defined results: null and empty texts are documents of one token, the end id 0. Repeated rows are
packed each. A document's pieces are its last tokens in pieces of `room`, after a first, shorter one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidied

ROOM = 2048
END_ID = 0
#: Rows that one task ranks, about.
RANKED = 50_000
_encoders: dict = {}


def encoder(vocabulary: str | None = None, fast: str | None = None):
    """text -> unsigned 32-bit ids of `tokenizers` with the vocabulary file, without added special tokens.

    `fast` names the same vocabulary as ranks: the same ids, by a quicker library. It is used only if both
    agree on a probe text, and never for texts that hold a special token's string.
    """
    if (vocabulary, fast) not in _encoders:
        import base64

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        file = vocabulary or P.path("byte_bpe_50k.json")
        slow = [Tokenizer.from_file(file)]
        special = [t.content for t in slow[0].get_added_tokens_decoder().values()]
        with open(fast or P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        quick = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def exact(text: str) -> np.ndarray:
            if not slow:
                slow.append(Tokenizer.from_file(file))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")

        probe = "It's 42  words,\n\n\tcafé niño 東京 🙂 it'll\r\n é  x_y-z 1234567 ​!!! ... "
        if agree := quick.encode_ordinary(probe) == exact(probe).tolist():
            slow.clear()  # most texts never need it

        def encode(text: str) -> np.ndarray:
            if not agree or any(s in text for s in special):
                return exact(text)
            return np.array(quick.encode_ordinary(text), "<u4")

        _encoders[vocabulary, fast] = encode
    return _encoders[vocabulary, fast]


def pieces(docs: DataFrame, room: int = ROOM, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""

    @tidied
    def cut(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), ([], [], [], [], [])
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                edges = [0, *range((len(tokens) - 1) % room + 1, len(tokens) + 1, room)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, x in zip(out, (doc_id, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Stock:
    """Counts by length, with the lengths in stock in order and how many pairs of them have each sum."""

    def __init__(self, counts: dict[int, int], room: int = ROOM):
        self.n = dict(counts)
        self.lengths = sorted(k for k, v in counts.items() if v)
        self.has = np.zeros(room + 1, bool)
        self.pairs = np.zeros(room + 1, np.int64)
        for x in self.lengths:
            self.has[x] = True
            self.pairs[x:] += self.has[: room + 1 - x]

    def take(self, parts: tuple[int, ...], times: int) -> None:
        for x in parts:
            self.n[x] -= times
            if not self.n[x]:
                del self.lengths[bisect_left(self.lengths, x)]
                self.pairs[x:] -= self.has[: len(self.has) - x]
                self.has[x] = False

    def times(self, parts: tuple[int, ...]) -> int:
        """How often all the parts can be taken together."""
        return min((self.n.get(x, 0) // parts.count(x) for x in set(parts)), default=0)


def _pair(stock: Stock, taken: tuple[int, ...], gap: int, most: int) -> tuple[int, ...] | None:
    """Two lengths in stock, beside those taken, that sum to gap exactly, the longer one of at most `most`: by a look-up of each complement."""
    if gap < 2 or not stock.pairs[gap]:
        return None
    both = stock.has[:gap][: most + 1] & stock.has[gap:0:-1][: most + 1]
    for a in np.flatnonzero(both)[::-1].tolist():
        if 2 * a < gap:
            break
        if stock.times((*taken, a, gap - a)):
            return (a, gap - a)
    return None


def _exact(stock: Stock, taken: tuple[int, ...], gap: int, most: int) -> tuple[int, ...] | None:
    """At most `most` lengths, three at most, in stock beside those taken that sum to gap exactly; fewest first, then longest first."""
    if not gap:
        return ()
    if stock.n.get(gap) and stock.times((*taken, gap)):
        return (gap,)
    if most < 2:
        return None
    if (found := _pair(stock, taken, gap, gap)) is not None or most < 3:
        return found
    for a in np.flatnonzero(stock.has[:gap] & (stock.pairs[gap:0:-1] > 0))[::-1].tolist():
        if 3 * a < gap:
            break
        if stock.times((*taken, a)) and (rest := _pair(stock, (*taken, a), gap - a, a)) is not None:
            return (a, *rest)
    return None


def _complement(stock: Stock, head: int, gap: int, whole: bool) -> tuple[tuple[int, ...], bool]:
    """(lengths, whether they fill the gap exactly): one length, or the longest that fits with one or two that complete it.

    If `whole`, any one, two or three lengths that fill the gap go before the longest alone.
    """
    if (rest := _exact(stock, (head,), gap, 1)) is not None:
        return rest, True
    k = bisect_left(stock.lengths, gap)
    while k and not stock.times((head, stock.lengths[k - 1])):
        k -= 1
    if not k:
        return (), False
    a = stock.lengths[k - 1]
    if (rest := _exact(stock, (head, a), gap - a, 2)) is not None:
        return (a, *rest), True
    if whole and (rest := _exact(stock, (head,), gap, 3)) is not None:
        return rest, True
    return (a,), False


def plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences have each: (lengths in order, times). Every piece is in one.

    Greedy orders win on different stocks: the plan is the one of fewest sequences of three.
    """
    made = (_exact_first(counts, room), _longest_first(counts, room, True), _longest_first(counts, room, False))
    return min(made, key=lambda patterns: sum(times for _, times in patterns))


class Open:
    """Groups of like open sequences: gap -> {pattern: times}."""

    def __init__(self, room: int):
        self.room, self.groups, self.gaps = room, {}, []

    def put(self, parts: tuple[int, ...], times: int) -> None:
        gap = self.room - sum(parts)
        if gap not in self.groups:
            self.groups[gap] = {}
            insort(self.gaps, gap)
        self.groups[gap][parts] = self.groups[gap].get(parts, 0) + times

    def fit(self, x: int, left: int) -> int:
        """How many of `left` pieces went into one group of the fullest open sequences with room for them; 0 if there are none."""
        k = bisect_left(self.gaps, x)
        if k == len(self.gaps):
            return 0
        gap = self.gaps[k]
        parts, times = next(iter(self.groups[gap].items()))
        used = min(times, left)
        if used == times:
            del self.groups[gap][parts]
            if not self.groups[gap]:
                del self.groups[gap]
                del self.gaps[k]
        else:
            self.groups[gap][parts] = times - used
        self.put((*parts, x), used)
        return used

    def patterns(self) -> list[tuple[tuple[int, ...], int]]:
        return [(parts, times) for group in self.groups.values() for parts, times in group.items()]


def _exact_first(counts: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Any exact filling of a longest piece by one, two or three in stock; what has none goes by best fit afterwards."""
    stock, done, residue, open_ = Stock(counts, room), [], {}, Open(room)
    while stock.lengths:
        x = stock.lengths[-1]
        if (rest := _exact(stock, (x,), room - x, 3)) is None:
            residue[x] = stock.n[x]
            stock.take((x,), stock.n[x])
        else:
            done.append(((x, *rest), n := stock.times((x, *rest))))
            stock.take((x, *rest), n)
    for x in sorted(residue, reverse=True):
        left = residue[x]
        while left:
            if used := open_.fit(x, left):
                left -= used
                continue
            each = room // x
            if full := left // each:
                open_.put((x,) * each, full)
            if left % each:
                open_.put((x,) * (left % each), 1)
            left = 0
    return done + open_.patterns()


def _longest_first(counts: dict[int, int], room: int, whole: bool) -> list[tuple[tuple[int, ...], int]]:
    """The longest piece into the fullest open sequence with room for it, else completed, else opened with the longest that fits.

    The number of steps depends on the number of distinct lengths, not of pieces: each step uses up a length
    or splits a group of open sequences once.
    """
    stock, done, open_ = Stock(counts, room), [], Open(room)
    while stock.lengths:
        x = stock.lengths[-1]
        if used := open_.fit(x, stock.n[x]):
            stock.take((x,), used)
        elif x == room:
            done.append(((x,), n := stock.n[x]))
            stock.take((x,), n)
        else:
            rest, exact = _complement(stock, x, room - x, whole)
            n = stock.times((x, *rest))
            stock.take((x, *rest), n)
            if exact:
                done.append(((x, *rest), n))
            else:
                open_.put((x, *rest), n)
    return done + open_.patterns()


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset) of the runs of places, by first rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for parts, times in patterns:
        offset = 0
        for x in parts:
            rows.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return {x: np.array(v, np.int64) for x, v in rows.items()}


def pack(docs: DataFrame, room: int = ROOM, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents with the sequence and the offset each goes to."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, room, vocabulary), "pieces")
    # at most `room` rows come to the driver
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # a row a place of a length in a pattern: bounded by `room` lengths, however many documents there are
    table = spark.sparkContext.broadcast(places(plan(counts, room)))
    salts = max(1, -(-max(counts.values(), default=0) // RANKED))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    if salts > 1:  # a row for each length and salt: as many as there are blocks of RANKED pieces
        starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        ranked = ranked.join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))

    @tidied
    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = length == x
                runs = table.value[int(x)]
                k = np.searchsorted(runs[:, 0], rank[at], "right") - 1
                sequence[at] = runs[k, 1] + rank[at] - runs[k, 0]
                offset[at] = runs[k, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
