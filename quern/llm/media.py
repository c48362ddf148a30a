"""Media columns: sniff what stored bytes really are, by signatures and format validators.

An Aho-Corasick automaton over the magic bytes of all known formats finds every place where a file may
begin; the format's validator then walks its structure and gives its true length. A medium whose
validated structure begins at byte 0 corrects the declared type; validated media further inside are carved.

Defined results: null payloads sniff as type null with no media; empty and unknown bytes sniff as
"bin"; truncated or corrupt structures are not media; equal bytes give equal results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffers, tidied

#: Magic bytes by format; the number is where they stand from the file's first byte.
MAGIC = (
    ("wav", b"RIFF", 0),
    ("png", b"\x89PNG\r\n\x1a\n", 0),
    ("gif", b"GIF87a", 0),
    ("gif", b"GIF89a", 0),
    ("jpeg", b"\xff\xd8\xff", 0),
    ("bmp", b"BM", 0),
    ("pgm", b"P5", 0),
    ("gzip", b"\x1f\x8b\x08", 0),
    ("zip", b"PK\x03\x04", 0),
    ("flac", b"fLaC", 0),
)
#: Bytes of the header that `wav_bytes` writes.
WAV_HEADER = 44
RATE = 8000


def _wav(b: bytes, at: int) -> int:
    """Length of a RIFF/WAVE file at `at`: its chunks must fill the size that the header gives, and hold fmt and data."""
    if len(b) - at < 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= end:
        kind, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if kind == b"fmt " and n < 16:
            return 0
        seen.add(kind)
        p += 8 + n + (n & 1)
    return end - at if p == end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n = struct.unpack_from(">I", b, p)[0]
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        kind = b[p + 4 : p + 8]
        if first and (kind != b"IHDR" or n != 13):
            return 0
        first = False
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _blocks_end(b: bytes, p: int) -> int:
    """Where a chain of length-prefixed GIF blocks ends, or 0."""
    while p < len(b):
        n = b[p]
        p += 1 + n
        if not n:
            return p
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21 and (p := _blocks_end(b, p + 2)):
            continue
        if kind == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p = _blocks_end(b, p + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
            if p:
                continue
        return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return 0
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data: up to a marker that is neither stuffed nor a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return 0
    return p + 2 - at if p + 2 <= len(b) and b[p : p + 2] == b"\xff\xd9" else 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) - at < 54:
        return 0
    size, _, start, header, w, h, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if header < 40 or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h or start < 14 + header:
        return 0
    need = start + (w * depth + 31) // 32 * 4 * abs(h)
    return size if need <= size <= len(b) - at else 0


def _pgm(b: bytes, at: int) -> int:
    fields, p = [], at + 2
    while len(fields) < 3:
        q = p
        while q < len(b) and b[q : q + 1].isspace():
            q += 1
        p = q
        while p < len(b) and p - q < 10 and 48 <= b[p] <= 57:
            p += 1
        if p == q or q == at + 2:
            return 0
        fields.append(int(b[q:p]))
    w, h, most = fields
    n = p + 1 - at + w * h * (1 if most < 256 else 2)
    return n if 0 < most < 65536 and w and h and p < len(b) and b[p : p + 1].isspace() and at + n <= len(b) else 0


def _gzip(b: bytes, at: int) -> int:
    d, p = zlib.decompressobj(31), at
    try:
        while not d.eof and (p < len(b) or d.unconsumed_tail):
            part = d.unconsumed_tail or b[p : p + 65536]
            p += 0 if d.unconsumed_tail else len(part)
            d.decompress(part, 1 << 20)
    except zlib.error:
        return 0
    return p - len(d.unused_data) - at if d.eof else 0


def _zips(b: bytes) -> dict[int, int]:
    """Lengths of the ZIP archives in b by where they begin: each end record tells that of its own."""
    out: dict[int, int] = {}
    p = b.find(b"PK\x05\x06")
    while p >= 0 and p + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, p + 12)
        if p + 22 + note <= len(b):
            out.setdefault(p - start - size, p + 22 + note - (p - start - size))
        p = b.find(b"PK\x05\x06", p + 1)
    return out


def _flac(b: bytes, at: int) -> int:
    """A FLAC stream gives no length: it is valid if its metadata blocks are, and takes the rest."""
    p, first = at + 4, True
    while p + 4 <= len(b):
        n = int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (b[p] & 0x7F or n != 34):
            return 0
        last, first = b[p] & 0x80, False
        p += 4 + n
        if last:
            return len(b) - at if p <= len(b) else 0
    return 0


VALIDATORS = {"wav": _wav, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pgm": _pgm, "gzip": _gzip, "flac": _flac}
_automaton = None


def _magic():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, magic, back in MAGIC:
            a.add_word(magic.decode("latin-1"), (kind, back + len(magic) - 1))
        a.make_automaton()
        _automaton = a
    return _automaton


def sniff(b: bytes) -> list[tuple[str, int, int]]:
    """Validated media in b: (kind, start, length), in order; what lies inside a carved medium's header chain isn't searched
    twice at the same place, and a medium inside another one is reported after it."""
    found, zips = [], None
    for end, (kind, back) in _magic().iter(b.decode("latin-1")):
        at = end - back
        if kind == "zip" and zips is None:
            zips = _zips(b)
        if n := zips.get(at) if kind == "zip" else VALIDATORS[kind](b, at):
            found.append((kind, at, n))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def wav_bytes(payload: bytes) -> bytes:
    """The payload as one channel of 8-bit samples in a WAV container; its length is even."""
    n = len(payload)
    return b"".join((b"RIFF", struct.pack("<I", 36 + n), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8), b"data", struct.pack("<I", n), payload))


def wav_samples(b: bytes) -> bytes:
    """The samples of a WAV file: its data chunk."""
    p = 12
    while b[p : p + 4] != b"data":
        n = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + n + (n & 1)
    return b[p + 8 : p + 8 + struct.unpack_from("<I", b, p + 4)[0]]


def sniff_media(df: DataFrame, payload: str = "payload", declared: str | None = None) -> DataFrame:
    """df with `media_type` (validated type at byte 0, else "bin"), `type_ok` (it equals `declared`) and
    `carved`: the validated media elsewhere in the payload as structs (kind, start, length). Columns of these names
    are replaced."""

    @tidied
    def look(batches):
        for batch in batches:
            kinds, carved = [], []
            for x in batch.column("payload").to_pylist():
                found = sniff(x) if x is not None else []
                whole = next((k for k, at, _ in found if at == 0), None)
                kinds.append(None if x is None else whole or "bin")
                carved.append([{"kind": k, "start": at, "length": n} for k, at, n in found if at])
            yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "media_type": pa.array(kinds, pa.string()), "carved": pa.array(carved, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))})

    made = ("media_type", "type_ok", "carved")
    rows = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in made or c == payload])
    # the row travels beside its payload as one opaque column, so that names can't clash
    out = df.select(rows.alias("k"), F.col(f"`{payload}`").cast("binary").alias("payload"))
    kind = out.schema["k"].dataType.simpleString()
    out = out.mapInArrow(look, f"k {kind}, media_type string, carved array<struct<kind:string,start:bigint,length:bigint>>")
    same = F.lit(None).cast("boolean") if declared is None else F.col("media_type") == F.col(f"k.`{declared}`")
    return out.select("k.*", "media_type", same.alias("type_ok"), "carved")


def document_media(docs: DataFrame) -> DataFrame:
    """Each text as a stored medium, read back: its sizes, digests and a line of features.

    The text's bytes are padded to a positive multiple of 64, stored as 8-bit WAV samples, sniffed and
    validated as if of unknown type, and the samples read back from the carved data chunk.
    """

    @tidied
    def make(batches):
        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            raw = raw.tobytes()
            out: dict[str, list] = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for i in range(len(off) - 1):
                text = raw[off[i] : off[i + 1]]
                stored = wav_bytes(text + bytes(-len(text) % 64 or (0 if text else 64)))
                found = sniff(stored)
                kind = next((k for k, at, n in found if at == 0 and n == len(stored)), "bin")
                back = wav_samples(stored) if kind == "wav" else stored
                count = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
                p = count[count > 0] / len(back)
                mean = float((count * np.arange(256)).sum() / len(back))
                carved = ";".join(f"{k}@{at - WAV_HEADER}+{n}" for k, at, n in found if at)
                out["n_bytes"].append(len(text))
                out["payload_bytes"].append(len(back))
                out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                out["tail_crc32"].append(zlib.crc32(back[-64:]))
                out["media_bytes"].append(len(stored))
                out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["feature"].append(f"type={kind} samples={len(back)} mean={mean:.3f} entropy={float(-(p * np.log2(p)).sum()):.3f} carved={carved}")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out})

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
