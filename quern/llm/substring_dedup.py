"""Substring deduplication by seed and extend on winnowed anchors.

A window is WIDTH consecutive words. Of the SEED-word grams in a window, the smallest hash (the rightmost
of equal ones) is its anchor, so equal windows have equal anchors at equal places, and each stretch of
windows around an anchor is as far as that seed extends both ways. Anchors that occur more than once
are joined: a stretch whose whole content starts earlier elsewhere is a repeat as a whole. Where
stretches share a seed but not all of their content, the first of each content is extended window by
window, and a window that starts earlier elsewhere is a repeat. Overlapping repeats add up to the maximal
ones, and their words go.

Only seeds, first starts (pre-aggregated) and repeats are shuffled, never pairs: a passage in a third of all
texts is as many rows as it has occurrences.

Defined results: null, empty and short texts keep all words; rows without a doc_id keep all words and are
no earlier occurrence; rows that share a doc_id are one document, and what goes goes from each of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import _ROLL, _mix, Scratch, Words, blocks, ngram_hashes, text_buffers, tidied

WIDTH = 20
SEED = 5


def _stretches(column, width: int, seed: int):
    """Per block of texts: text index, start, last start, seed hash, content hash of each stretch; and the window hashes with their base.

    Starts count words within a text; windows of a stretch are hashes[at : at + last - start + 1].
    """
    raw, off = text_buffers(column)
    grams = width - seed + 1
    for i, j in blocks(off):
        words = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        n = len(words.hash) - width + 1
        if n <= 0:
            continue
        g, win = ngram_hashes(words.hash, seed), ngram_hashes(words.hash, width)
        text = np.repeat(np.arange(j - i), np.diff(words.first))
        inside = np.flatnonzero(text[:n] == text[width - 1 :])
        if not len(inside):
            continue
        seen = np.lib.stride_tricks.sliding_window_view(g, grams)[:n]
        own = np.arange(n) + grams - 1 - np.argmin(seen[:, ::-1], 1)
        win, own, text = win[inside], own[inside], text[inside]
        new = np.ones(len(win), bool)
        new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(win)))
        place = np.arange(len(win)) - np.repeat(at, count)
        content = _mix(np.add.reduceat(win * _ROLL[place], at) + count.astype(np.uint64))
        start = inside[at] - words.first[text[at]]
        yield i + text[at], start, start + count - 1, g[own[at]], content, at, win


def _head(content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of one occurrence of a content."""
    return _mix(content ^ _mix(doc.view(np.uint64) * _ROLL[7] + start.astype(np.uint64) * _ROLL[8]))


_STRETCH = "seed bigint, content bigint, head bigint, doc_id bigint, start int, last int"


def repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, start, stop: word ranges whose every word is in a window that starts earlier elsewhere."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")

    @tidied
    def seeds(batches):
        for batch in batches:
            for *_, g, _, _, _ in _stretches(batch.column("text"), width, seed):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], ["seed"])

    common = scratch.keep(docs.mapInArrow(seeds, "seed bigint").groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"), "seeds")
    often = spark.sparkContext.broadcast(bloom.build(common, "seed"))
    scratch.drop("seeds")

    @tidied
    def stretches(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"), np.int64)
            for text, start, last, g, content, _, _ in _stretches(batch.column("text"), width, seed):
                ok = often.value.has(g)
                text, start, last, g, content = (x[ok] for x in (text, start, last, g, content))
                doc = ids[text]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.view(np.int64), content.view(np.int64), _head(content, doc, start).view(np.int64), doc, start.astype(np.int32), last.astype(np.int32))], ["seed", "content", "head", "doc_id", "start", "last"])

    found = scratch.keep(docs.mapInArrow(stretches, _STRETCH), "stretches")
    firsts = found.groupBy("content").agg(F.min(F.struct("doc_id", "start", "head", "seed")).alias("first"), F.count("*").alias("n"))
    firsts = scratch.keep(firsts.select("content", "first.*", "n"), "firsts")
    of_many = firsts.filter("n > 1").select("content", F.col("doc_id").alias("d"), F.col("start").alias("s"))
    whole = found.join(of_many, "content").filter("doc_id <> d or start <> s").select("doc_id", "start", (F.col("last") + width).alias("stop"))
    whole = scratch.keep(whole, "whole")
    scratch.drop("stretches")

    varied = firsts.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed")
    heads = spark.sparkContext.broadcast(bloom.build(firsts.join(varied, "seed").select("head"), "head"))
    scratch.drop("firsts")

    @tidied
    def windows(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"), np.int64)
            for text, start, last, _, content, at, win in _stretches(batch.column("text"), width, seed):
                ok = heads.value.has(_head(content, ids[text], start))
                text, start, at, count = text[ok], start[ok], at[ok], (last - start + 1)[ok]
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays([pa.array(win[np.repeat(at, count) + place].view(np.int64)), pa.array(np.repeat(ids[text], count)), pa.array((np.repeat(start, count) + place).astype(np.int32))], ["w", "doc_id", "start"])

    single = scratch.keep(docs.mapInArrow(windows, "w bigint, doc_id bigint, start int"), "windows")
    first = single.groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("w", "first")
    later = single.join(first, "w").filter(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", (F.col("start") + width).alias("stop"))
    later = scratch.keep(later, "later")
    scratch.drop("windows")
    return whole.union(later)


def deduplicate(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by one space."""
    ranges = repeats(docs, width, seed).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    @tidied
    def cut(batches):
        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            starts, stops = batch.column("starts"), batch.column("stops")
            n_words, n_removed, kept = [], [], []
            for i, j in blocks(off):
                words = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                change = np.zeros(len(words.starts) + 1, np.int32)
                for k in range(i, j):
                    if starts[k].is_valid:
                        # rows that share a doc_id may have other texts: ranges end where the text does
                        low, high = words.first[k - i], words.first[k - i + 1]
                        np.add.at(change, np.minimum(low + starts[k].values.to_numpy(), high), 1)
                        np.add.at(change, np.minimum(low + stops[k].values.to_numpy(), high), -1)
                stay = np.cumsum(change[:-1]) == 0
                a, length = words.starts[stay], (words.ends - words.starts)[stay]
                place = np.cumsum(length + 1) - length - 1
                out = np.full(int((length + 1).sum()), 0x20, np.uint8)
                inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                out[np.repeat(place, length) + inside] = words.raw[np.repeat(a, length) + inside]
                here = np.concatenate(([0], np.cumsum(stay)))[words.first]
                edge = np.append(place, len(out))
                text = out.tobytes()
                for k in range(j - i):
                    n_words.append(words.first[k + 1] - words.first[k])
                    n_removed.append(n_words[-1] - (here[k + 1] - here[k]))
                    kept.append(text[edge[here[k]] : edge[here[k + 1]] - 1] if here[k + 1] > here[k] else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text").join(ranges, "doc_id", "left").select("doc_id", "text", "starts", "stops").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
