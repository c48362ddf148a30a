"""What the training-data operators share: tables kept in the shared folder, and word hashes over Arrow buffers."""

from __future__ import annotations

import atexit
import functools
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The bytes that end a word.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: A word, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are hashed in blocks of about so many bytes, which bounds the memory of one step.
BLOCK_BYTES = 1 << 19


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables written to the folder that `spark.checkpoint.dir` names, so that every executor can read them again.

    `keep` cuts lineage: what it returns reads the written table. `drop` deletes a table that no later
    step reads; tables that a lazily evaluated result still reads are deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.clear)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None or sc._jvm is None:
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the session has ended; the folder stays
            pass


def tidied(f):
    """A function of Arrow batches that gives the memory it has freed back when its partition ends: workers are used again."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the result depends on every bit of x (unsigned 64-bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240229)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random number for each byte at each of the first places of a word; what follows in long words is mixed with its place.
_PLACES = 64
_AT = _rng.integers(0, 1 << 63, (_PLACES, 256), dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, (_PLACES, 256), dtype=np.uint64)


def _letters(letters: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each byte at its place in its word: sums of them are no polynomial that two words could share by their form."""
    out = _AT[place & (_PLACES - 1), letters]
    far = place >= _PLACES
    if far.any():
        out[far] = _mix(out[far] + (place[far] // _PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls count as empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Runs (i, j) of whole texts of about `most` bytes each; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a run of texts: byte ranges, hashes, and the first word of each text.

    starts, ends: byte ranges in `raw`; hash: 64-bit hashes of the words; first: for n texts, n + 1 indexes.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        is_word = _IS_WORD[raw]
        # a text's end ends its last word: starts also lie where a text begins
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(raw), bool)
        if len(raw):
            before[0] = False
            before[1:] = is_word[:-1]
        starts = np.flatnonzero(is_word & (~before | edge[: len(raw)]))
        after = np.empty(len(raw), bool)
        if len(raw):
            after[-1] = False
            after[:-1] = is_word[1:]
        ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        lengths = ends - starts
        if len(starts):
            inside = raw[is_word]
            if lower:
                inside = _LOWER[inside]
            at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            place = np.arange(len(inside)) - np.repeat(at, lengths)
            self.hash = _mix(np.add.reduceat(_letters(inside, place), at) + lengths.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.raw, self.starts, self.ends = raw, starts, ends
        self.first = np.searchsorted(starts, offsets, "left")


_ROLL = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive words of one sequence of word hashes; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total += words[i : i + m] * _ROLL[i]
    return _mix(total)


def sequence_hash(words: np.ndarray) -> int:
    """One hash of a whole sequence of words."""
    n = len(words)
    total = _mix(words + np.arange(1, n + 1, dtype=np.uint64) * _ROLL[:1]).sum(dtype=np.uint64)
    return int(_mix(np.array([total], np.uint64) + np.array([n], np.uint64) * _ROLL[255:256])[0])
