"""Near-duplicate documents by bottom-k sketches, with exact Jaccard similarity on every link.

One hash function gives each distinct 5-word shingle a value; a document's sketch is its SKETCH smallest
values. Documents with equal shingle sets are one node. Inverted lists of the retained values propose
pairs: of its values, rarest in the corpus first, a node enters the lists of only so many that two
similar nodes must meet in one (two sets of similarity 0.75 share, of the SKETCH smallest values of their
union, at least LEAST but for a chance below 1e-8). A list first compares its members with its hub, the
one whose values are the most common; pairs pass if their union sketch allows the similarity, and link if
their full sets have it. Lists that hold several components then still compare the members of different
components, on their full sets: all lists of a hub together, in bounded blocks, which answer with links that
join components and never with more rows than they have members.

Nothing is capped: a list of any length is compared whole, and one whose members are already connected
needs no further pairs.

Defined results: null and empty texts have no shingles and are linked with nothing; rows without a doc_id
are linked with nothing, have a null component and are kept; repeated rows are one node; rows that
share a doc_id but not a text are nodes under one id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, Words, blocks, ngram_hashes, sequence_hash, text_buffers, tidied
from .components import components

WIDTH = 5
SKETCH = 64
#: Retained values that two similar documents' sketches have in common, at least.
LEAST = 27
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Members and shingles of a compared block, about.
BLOCK, BLOCK_SHINGLES = 1024, 1_500_000
#: Members of one list that a task meets together, about: longer lists are dealt by their members too.
LIST = 1024
#: Partners that a node's full set meets in one task, about.
PARTNERS = 128


def shingle_sets(column):
    """The sorted distinct shingle hashes of each text of an Arrow column, one after another."""
    raw, off = text_buffers(column)
    for i, j in blocks(off):
        words = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        grams = ngram_hashes(words.hash, WIDTH)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= WIDTH:
                yield np.unique(grams[a : b - WIDTH + 1])
            elif b > a:
                yield np.array([sequence_hash(words.hash[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _key(s: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set) and sketch (ascending as unsigned) of each document."""

    @tidied
    def make(batches):
        for batch in batches:
            n, keys, sketch = [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                keys.append(_key(s))
                sketch.append(s[:SKETCH].view(np.int64))
            at = np.concatenate(([0], np.cumsum([len(x) for x in sketch]))).astype(np.int32)
            flat = np.concatenate(sketch) if sketch else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "n_shingles", "set_key", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id bigint, n_shingles bigint, set_key binary, sketch array<bigint>")


def _shared_least(n: Column) -> Column:
    """How many retained values a similar partner shares, at least, by the set's size."""
    return F.when(n < 49, F.ceil(n * SIMILAR / 100)).otherwise(LEAST).cast("int")


def _possible(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILAR


def _part(m: Column, of: str = "node", size: int | None = None) -> Column:
    """Which part of a list of about m members a node is in."""
    return F.pmod(F.xxhash64(of), F.ceil(m / (size or LIST))).cast("int")


def _parts(m: Column, size: int | None = None) -> Column:
    """All parts of a list of about m members, a row each."""
    return F.explode(F.sequence(F.lit(0), F.ceil(m / (size or LIST)).cast("int") - 1))


def _union_sketch_allows() -> Column:
    """Whether the sketches' union, cut to its bottom values, holds enough common ones. Bottom is by unsigned order."""
    unsigned = lambda s: F.transform(s, lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))
    a, b = unsigned(F.col("sketch_a")), unsigned(F.col("sketch_b"))
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    whole = (F.col("n_a") <= SKETCH) & (F.col("n_b") <= SKETCH)
    exact = F.size(F.array_intersect(a, b)) * 100 >= F.size(F.array_union(a, b)) * SIMILAR
    return F.when(whole, exact).otherwise(common >= LEAST)


def _links_in_block(rows):
    """Pairs of components (a, b) that links join, among the members of one block or two that meet, by their full sets."""
    import pandas as pd

    comp, home = rows["component"].to_numpy(), rows["block"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows["whole"]]
    n = np.array([len(x) for x in sets], np.int64)
    value, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), n)
    often = np.bincount(at, minlength=len(value)) > 1
    column = np.cumsum(often) - 1
    owner, at = owner[often[at]], column[at[often[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    shared = np.zeros((len(rows), len(rows)), np.float32)
    for a in range(0, int(often.sum()), 2048):
        part = np.zeros((len(rows), 2048), np.float32)
        i, j = np.searchsorted(at, (a, a + 2048))
        part[owner[i:j], at[i:j] - a] = 1
        shared += part @ part.T
    union = n[:, None] + n[None, :] - shared
    ok = np.triu((100 * shared >= SIMILAR * union) & (comp[:, None] != comp[None, :]), 1)
    if len(np.unique(home)) > 1:  # within one block its own group compares
        ok &= home[:, None] != home[None, :]
    i, j = np.nonzero(ok)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    _, first = np.unique(np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])], 1), axis=0, return_index=True)
    for k in first:
        x, y = find(comp[i[k]]), find(comp[j[k]])
        if x != y:
            root[x] = y
            out.append((comp[i[k]], comp[j[k]]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


class _Linker:
    def __init__(self, docs: DataFrame, nodes: DataFrame, scratch: Scratch):
        self.docs, self.nodes, self.scratch = docs, nodes, scratch

    def sets(self, wanted: DataFrame, name: str) -> DataFrame:
        """node, whole: the full sets of the wanted nodes, from their texts."""
        wanted = self.scratch.keep(wanted.join(self.nodes.select("node", "set_key"), "node"), f"{name}-wanted")

        # the filter spares shuffling texts; the join decides which sets are wanted
        maybe = self.docs.sparkSession.sparkContext.broadcast(bloom.build(wanted.select(F.xxhash64("node").alias("h")), "h"))

        @tidied
        def make(batches):
            for batch in batches:
                batch = batch.filter(pa.array(maybe.value.has(np.asarray(batch.column("h"), np.int64).view(np.uint64))))
                out = [(_key(s), s.tobytes()) for s in shingle_sets(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())], ["node", "set_key", "whole"])

        rows = self.docs.filter("doc_id is not null").select(F.col("doc_id").alias("node"), F.xxhash64("doc_id").alias("h"), "text")
        made = rows.mapInArrow(make, "node bigint, set_key binary, whole binary")
        made = self.scratch.keep(made.join(wanted, ["node", "set_key"], "left_semi").select("node", "whole"), f"{name}-sets")
        self.scratch.drop(f"{name}-wanted")
        # repeated rows have equal sets: one of each stays
        return made.dropDuplicates(["node"])

    def met(self, pairs: DataFrame, likely: DataFrame, sets: DataFrame, side: str, other: str, name: str) -> DataFrame:
        """The pairs with the full set of one side; a node of many partners meets them in parts, by the other side."""
        many = self.scratch.keep(likely.groupBy(side).agg(F.count("*").alias("m")).filter(F.col("m") > PARTNERS), name)
        pairs = pairs.join(many, side, "left").withColumn("part", _part(F.coalesce("m", F.lit(1)), other, PARTNERS)).drop("m")
        sets = sets.select(F.col("node").alias(side), F.col("whole").alias(f"whole_{side}"))
        sets = sets.join(many, side, "left").withColumn("part", _parts(F.coalesce("m", F.lit(1)), PARTNERS)).drop("m")
        return pairs.join(sets, [side, "part"]).drop("part")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that the union sketch allows and whose full sets are similar."""
        keep, nodes = self.scratch.keep, self.nodes
        side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
        likely = keep(pairs.join(side("a"), "a").join(side("b"), "b").filter(_union_sketch_allows()).select("a", "b"), f"{name}-likely")
        sets = self.sets(likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct(), name)

        @tidied
        def similar(batches):
            for batch in batches:
                ok = []
                for x, y in zip(batch.column("whole_a"), batch.column("whole_b"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        both = self.met(self.met(likely, likely, sets, "a", "b", f"{name}-many-a"), likely, sets, "b", "a", f"{name}-many-b")
        links = keep(both.select("a", "b", "whole_a", "whole_b").mapInArrow(similar, "a bigint, b bigint"), f"{name}-links")
        self.scratch.drop(f"{name}-likely", f"{name}-sets", f"{name}-many-a", f"{name}-many-b")
        return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    keep = scratch.keep
    made = keep(sketches(docs).withColumn("set_key", F.when(F.col("doc_id").isNotNull(), F.col("set_key"))), "sketches")
    nodes = keep(made.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "nodes")

    values = nodes.select("node", "n", F.explode("sketch").alias("v"))
    # a written table: where a value is in very many sketches, Spark can split its side of the join
    often = keep(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    retained = F.least(F.col("n"), F.lit(SKETCH)).cast("int")
    mine = values.join(often, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("values"))
    # a node's values that are in no other sketch are its rarest, so they use up that much of its prefix
    left = retained - _shared_least(F.col("n")) + 1 - (retained - F.size("values"))
    common = F.aggregate("values", F.lit(0.0), lambda t, x: t + F.log(x["df"]))
    listed = keep(mine.filter(left > 0).select("node", "n", common.alias("common"), F.explode(F.slice("values", F.lit(1), left)).alias("x")).select("node", "n", "common", "x.v", "x.df"), "lists")
    scratch.drop("often")

    # a list has at most as many members as sketches have its value, which both sides know: its parts follow from that
    hubs = listed.groupBy("v", "df").agg(F.max(F.struct("common", (-F.col("node")).alias("hub"), F.col("n").alias("hub_n"))).alias("x"), F.count("*").alias("m")).filter("m > 1")
    hubs = hubs.select("v", _parts(F.col("df")).alias("part"), "m", (-F.col("x.hub")).alias("hub"), "x.hub_n")
    members = keep(listed.withColumn("part", _part(F.col("df"))).join(hubs, ["v", "part"]).select("v", "m", "node", "n", "hub", "hub_n"), "members")
    scratch.drop("lists")
    stars = members.filter((F.col("node") != F.col("hub")) & _possible(F.col("n"), F.col("hub_n"))).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    linker = _Linker(docs, nodes, scratch)
    links = linker.verified(stars, "stars")
    labels = components(links, scratch, "first")

    # lists of two are settled; longer ones are if their members are connected
    labelled = members.filter("m > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = labelled.groupBy("v", "m").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("v", _parts(F.col("m")).alias("part"))
    together = keep(labelled.withColumn("part", _part(F.col("m"))).join(open_, ["v", "part"], "left_semi").select("hub", "node", "n", "component").distinct(), "together")
    wide = together.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("wide"))
    # hubs of one block need no row here; a written table lets Spark split a common hub's side of the join
    wide = keep(wide.filter("wide > 1"), "wide")
    met = together.join(wide, "hub", "left").withColumn("wide", F.coalesce("wide", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("wide")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).select("hub", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "component", "block")
    # blocks of one component have nothing to compare
    worth = met.groupBy("hub", "lo", "hi").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("hub", "lo", "hi")
    met = keep(met.join(worth, ["hub", "lo", "hi"]), "met")
    scratch.drop("members", "together", "wide")
    of_set = nodes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("c"))
    if not met.isEmpty():
        sets = linker.sets(met.select("node").distinct(), "blocks")
        more = met.join(sets, "node").groupBy("hub", "lo", "hi").applyInPandas(_links_in_block, "a bigint, b bigint")
        joined = components(more, scratch, "second").select(F.col("node").alias("c"), F.col("component").alias("d"))
        of_set = of_set.join(joined, "c", "left").select("set_key", F.coalesce("d", "c").alias("c"))
    scratch.drop("met", "blocks-sets", "stars-links")
    out = made.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
