"""Near-duplicate documents: one-permutation MinHash, banded buckets and stars.

1. Texts with equal sets of word shingles become one node. Each node has one hash
   per shingle, dealt to bins by one permutation; an empty bin takes the value of a
   bin that holds one, found by its own sequence of probes (optimal densification),
   so that any two sets agree in a bin with the chance of their similarity.
2. Bands of bins are bucket keys. A bucket gives a star and not its pairs: every
   member is set against one hub, the least node, exactly and on the whole sets.
3. Links contract to components. A bucket whose other members are in one component
   is done. The rest, members unlike their hubs, meet in cells of two blocks, where
   signatures drop clearly different pairs and sets decide the others. No member is
   left out at any step.

A pair at the threshold agrees in no band with a chance of about 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, small, staged, texts
from .hashing import U64, mix, shingle_sets
from .ngram_join import components, whole_cells


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 85  # least similarity, 100 * intersection / union
    bands: int = 30
    rows: int = 5
    rounds: int = 1  # of stars before the cells
    broadcast: int = 1_000_000  # text hashes that may be broadcast (8 bytes each); more are joined by shuffle
    block: int = 400  # members of a block; a star or a cell has two blocks at most
    loss: float = 1e-9  # bound of the chance that signatures drop a pair at the threshold from a cell

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def probes(bins: int, length: int = 64) -> np.ndarray:
    """For each bin the bins that it asks, in order, when it is empty."""
    n = np.arange(1, bins * length + 1, dtype=U64)
    return (mix(n * U64(0xD6E8FEB86659FD93)) % U64(bins)).astype(np.int64).reshape(bins, length)


def one_permutation(shingles: np.ndarray, bins: int, ask: np.ndarray) -> np.ndarray:
    """The least 32-bit value of each bin, empty bins densified, 16 mixed bits of each."""
    h = mix(shingles ^ U64(0xA24BAED4963EE407))
    where, value = (h >> U64(32)) * U64(bins) >> U64(32), h & U64(0xFFFFFFFF)
    least = np.full(bins, U64(1) << U64(40))
    np.minimum.at(least, where.astype(np.int64), value)
    full = least < U64(1) << U64(40)
    if not full.all():
        empty = np.flatnonzero(~full)
        hits = full[ask[empty]]
        source = ask[empty, hits.argmax(axis=1)]
        missed = ~hits.any(axis=1)  # no probe met a full bin: take the next full one
        if missed.any():
            there = np.flatnonzero(full)
            source[missed] = there[np.searchsorted(there, empty[missed]) % len(there)]
        least[empty] = least[source]
    return (mix(least) >> U64(48)).astype(np.uint16)


def least_agreeing(sizes: np.ndarray, s: Settings) -> np.ndarray:
    """How many bins must agree for sets of these sizes at least: with the bins that a
    set fills as independent trials, a pair at the threshold stays below with a chance
    of ``loss`` at most (Chernoff)."""
    filled = s.bins * (1 - np.exp(-np.asarray(sizes, float) / s.bins))
    p, low, high = s.percent / 100, np.zeros(len(filled)), np.full(len(filled), s.percent / 100)
    for _ in range(40):
        x = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.where(x > 0, x * np.log(x / p), 0) + (1 - x) * np.log((1 - x) / (1 - p))
        far = filled * gap >= -np.log(s.loss)
        low, high = np.where(far, x, low), np.where(far, high, x)
    return np.floor(low * s.bins)


def lowered(values: list[str | None]) -> list[str]:
    """A-Z lower-cased and nothing else."""
    return [v.encode().lower().decode() for v in values]


def signatures(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, node, version, signature) of every whole text: size, digest
    and bins of its shingle set; node and signature are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = probes(s.bins)
        for batch in batches:
            sizes, nodes, values = [], [], []
            for shingles in shingle_sets(lowered(batch.column(1).to_pylist()), s.words):
                sizes.append(len(shingles))
                nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                values.append(one_permutation(shingles, s.bins, ask).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), batch.column(2), pa.array(values, pa.binary())],
                ["doc_id", "n_shingles", "node", "version", "signature"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    return source.mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, version long, signature binary")


def sets(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(node, shingles): the sorted shingle hashes of texts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(lowered(batch.column(0).to_pylist()), s.words)]
            nodes = [xxhash.xxh3_128_digest(x) if x else None for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.binary())], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node binary, shingles binary").filter("node is not null")


def band_keys(nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(key, band, node): one row per band of every node; keys of different bands differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, s.bands + 1, dtype=U64) * U64(0x8CB92BA72F3D8DD7))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, s.bands, s.rows)
            key = np.zeros((n, s.bands), U64)
            for r in range(s.rows):
                key = mix(key + values[:, :, r].astype(U64) + U64(1)) ^ salt
            band = np.tile(np.arange(s.bands, dtype=np.int32), n)
            node = batch.column(0).take(pa.array(np.repeat(np.arange(n), s.bands)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), node], ["key", "band", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, band int, node binary")


def linked(shared: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes of intersections with sets of sizes a and b reach the threshold."""
    return 100 * shared >= percent * (a + b - shared)


def shared_with(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others, none of which is empty."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    return np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def verified_stars(edges: DataFrame, shingles: DataFrame, s: Settings) -> DataFrame:
    """(a, b): the edges (hub, node) whose sets are similar. The members of a hub are
    dealt to blocks; each block has the hub's set once."""
    sized = edges.groupBy("hub").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / s.block).cast("int"))
    spread = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = edges.join(sized, "hub").select("hub", spread.alias("part"), "node").join(shingles, "node")
    hubs = sized.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("hub").alias("node")).join(shingles, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, 2):
            hub, part, head, node, data = (table.column(k).to_pylist() for k in range(5))
            a, b, start = [], [], 0
            for k in range(1, len(hub) + 1):
                if k < len(hub) and hub[k] == hub[start] and part[k] == part[start]:
                    continue
                # the row of the hub comes first
                if k - start > 1 and head[start] == 0:
                    one = np.frombuffer(data[start], U64)
                    others = [np.frombuffer(x, U64) for x in data[start + 1 : k]]
                    good = linked(shared_with(one, others), len(one), np.array([len(x) for x in others]), s.percent)
                    found = [n for n, g in zip(node[start + 1 : k], good, strict=True) if g]
                    a += [hub[start]] * len(found)
                    b += found
                start = k
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    both = hubs.select("hub", "part", F.lit(0).alias("head"), "node", "shingles").unionByName(
        members.select("hub", "part", F.lit(1).alias("head"), "node", "shingles")
    )
    dealt = both.repartition(tasks(both), "hub", "part").sortWithinPartitions("hub", "part", "head")
    return dealt.mapInArrow(run, "a binary, b binary")


def verified_cells(members: DataFrame, info: DataFrame, shingles: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links between members (key, band, node, root) of different components in one
    bucket. A bucket is dealt to blocks, and each two blocks are a cell; signatures
    choose what is verified in a cell, and only its members travel, never pairs. A
    pair of several buckets is judged in the first: was that bucket done, the pair
    is in one component or one of the two has met it as its hub."""
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, "key").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "node", "root").join(info, "node")

    def cell_runs(table: pa.Table) -> Iterator[tuple[int, int]]:
        keys = [table.column(c).to_numpy() for c in range(3)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        yield from zip([0, *change.tolist()], [*change.tolist(), table.num_rows], strict=True)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            key, i, j, own, band = (table.column(k).to_numpy() for k in range(5))
            node, root = (np.array(table.column(k).to_pylist(), object) for k in (5, 6))
            size = table.column(7).to_numpy()
            values = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint16).reshape(len(key), s.bins)
            least = least_agreeing(size, s)
            at, partners = [], []
            for x, y in cell_runs(table):
                _, code = np.unique(root[x:y], return_inverse=True)
                lists: dict[int, np.ndarray] = {}
                for m in range(x, y):
                    # within one block the pairs of later rows, of two blocks those across
                    fits = (own[x:y] == j[x]) if i[x] != j[x] else np.arange(x, y) > m
                    if i[x] != j[x] and own[m] != i[x]:
                        continue
                    small, big = np.minimum(size[x:y], size[m]), np.maximum(size[x:y], size[m])
                    fits &= (code != code[m - x]) & (100 * small >= s.percent * big)
                    some = np.flatnonzero(fits) + x
                    if len(some):
                        same = values[some] == values[m]
                        earlier = same[:, : band[m] * s.rows].reshape(len(some), band[m], s.rows).all(axis=2).any(axis=1)
                        some = some[(same.sum(axis=1) >= np.minimum(least[some], least[m])) & ~earlier]
                    if len(some):
                        lists[m] = some
                for m in sorted({*lists, *(int(o) for v in lists.values() for o in v)}):
                    at.append(m)
                    partners.append(node[lists[m]].tolist() if m in lists else [])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[at], pa.int64()), pa.array(i[at], pa.int32()), pa.array(j[at], pa.int32()),
                    pa.array(node[at].tolist(), pa.binary()), pa.array(partners, pa.list_(pa.binary())),
                ],
                ["key", "i", "j", "node", "partners"],
            )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            node, partners, data = (table.column(k).to_pylist() for k in (3, 4, 5))
            a, b = [], []
            for x, y in cell_runs(table):
                have = {node[k]: np.frombuffer(data[k], U64) for k in range(x, y)}
                for k in range(x, y):
                    if partners[k]:
                        others = [have[p] for p in partners[k]]
                        one = have[node[k]]
                        good = linked(shared_with(one, others), len(one), np.array([len(o) for o in others]), s.percent)
                        found = [p for p, g in zip(partners[k], good, strict=True) if g]
                        a += [node[k]] * len(found)
                        b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    ordered = cells.select("key", "i", "j", "own", "band", "node", "root", "n_shingles", "signature")
    ordered = ordered.repartition(tasks(cells), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    proposed = staged(ordered.mapInArrow(propose, "key long, i int, j int, node binary, partners array<binary>"), "cells")
    with_sets = proposed.join(shingles, "node").select("key", "i", "j", "node", "partners", "shingles")
    with_sets = with_sets.repartition(tasks(cells), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return with_sets.mapInArrow(verify, "a binary, b binary")


def node_roots(nodes: DataFrame, text: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(node, root): the least node connected to each of the ``nodes`` (node, version,
    n_shingles, signature) that has a link; ``text`` has their texts (version, text)."""
    bands = staged(band_keys(nodes, s), "bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    alive = staged(bands.join(shared, "key"), "buckets")
    met = alive.select("node").distinct()
    # without the broadcast all texts would cross the network for the few in a bucket
    needed = small(staged(nodes.join(met, "node", "left_semi").select("version").distinct(), "versions"), s.broadcast)
    found = sets(text.join(needed, "version", "left_semi"), s).join(met, "node", "left_semi")
    shingles = staged(found.dropDuplicates(["node"]), "sets")
    links, roots = None, None
    for n in range(s.rounds + 1):
        members = alive.withColumn("root", F.col("node")) if roots is None else alive.join(roots, "node", "left").select(
            "key", "band", "node", F.coalesce("root", "node").alias("root")
        )
        open_keys = members.groupBy("key").agg(F.min("node").alias("hub"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
        members = staged(members.join(open_keys.select("key", "hub"), "key"), "open-buckets")
        if members.isEmpty():
            break
        if n == s.rounds:
            found = verified_cells(members.drop("hub"), nodes.select("node", "n_shingles", "signature"), shingles, s)
        else:
            hubs = members.filter("hub = node").select("key", F.col("root").alias("hub_root"))
            edges = members.join(hubs, "key").filter("hub <> node and root <> hub_root").select("hub", "node").distinct()
            found = verified_stars(staged(edges, "stars"), shingles, s)
            # a hub has met all others of its bucket
            alive = members.filter("hub <> node").select("key", "band", "node")
        found = staged(found.distinct(), "star-links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = components(links, "star-components")
    return nodes.select("node", F.col("node").alias("root")) if roots is None else roots


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document (doc_id, text).

    ``component_id`` is the least doc_id of the documents that links connect. A text
    of fewer words than a shingle, but not none, is one shingle; a text without
    words, or null, is linked with nothing. Rows that repeat an id are linked by
    their texts; several texts of one id are nodes of their own. A row without an
    id takes part through its text, and its component is null if no connected
    document has an id. Repeated rows stay repeated; other columns are not read.
    """
    prepare(docs.sparkSession)
    source = texts(docs)
    marked = staged(signatures(source, s), "signatures")
    chosen = marked.filter("node is not null").groupBy("node").agg(F.min(F.struct("version", "n_shingles", "signature")).alias("c"))
    chosen = chosen.select("node", "c.version", "c.n_shingles", "c.signature")
    # one text of each node, found again by its hash
    roots = node_roots(chosen, source.select(F.xxhash64("text").alias("version"), "text"), s)
    own = marked.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("own"))
    rooted = own.join(roots, "node", "left").select("node", "own", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("own").alias("component_id"))
    by_node = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    worded = marked.filter("node is not null").select("doc_id", "n_shingles", "node").join(by_node, "node")
    alone = marked.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return worded.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_first(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with the document of least id of each component; all columns stay.
    Rows that repeat an id stay together; those without an id stay."""
    gone = classes(docs.select("doc_id", "text"), s).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    return classes(docs, s).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
