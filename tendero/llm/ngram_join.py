"""N-gram Jaccard self-join: all pairs of documents whose sets of word shingles
have a similarity of at least the threshold.

1. Every text gives its shingle set, a digest of it and MinHash values. Equal sets
   become one numbered class with a count.
2. Bands of MinHash values propose pairs. With 20 bands of three values a pair at
   0.8 is missed with a chance of 5.9e-7. Buckets of one member leave; a large bucket
   is cut into blocks and each pair of blocks is a cell of bounded size, so no task
   meets a whole bucket. A pair that shares several bands is judged in the first.
3. In a cell the values are compared a slice at a time, and after each slice pairs
   leave whose posterior chance of reaching the threshold is below the tolerance; all looks
   together drop a pair at 0.8 with a chance of 4.9e-8.
4. What is left is verified exactly on the shingle sets, inside the cell: the rows
   that travel are members, never pairs. Each member leaves with its number of
   links and the least member it is connected to.
5. Stars of those edges are contracted to connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged, texts
from .hashing import U64, mix, shingle_sets


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 3
    step: int = 10  # values compared between two looks at the posterior
    tolerance: float = 1e-8
    broadcast: int = 1_000_000  # ids that may be broadcast (8 bytes each); more are joined by shuffle
    block: int = 400  # members of a block; a cell has two at most

    @property
    def values(self) -> int:
        return self.bands * self.rows


@lru_cache
def least_matches(s: Settings) -> tuple[int, ...]:
    """After each slice, the least matches at which a pair may stay.

    With a uniform prior, m matches in n values leave the similarity a Beta(m + 1,
    n - m + 1) posterior, whose tail beyond the threshold is that of a binomial:
    at most m successes in n + 1 trials of the threshold.
    """
    out = []
    for n in range(s.step, s.values + 1, s.step):
        probability, tail, m = (1 - s.threshold) ** (n + 1), 0.0, 0
        while m <= n:
            tail += probability
            if tail >= s.tolerance:
                break
            probability *= (n + 1 - m) / (m + 1) * s.threshold / (1 - s.threshold)
            m += 1
        out.append(m)
    return tuple(out)


def minhash(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """16-bit pieces of MinHash values: enough to tell values apart, as every pair
    is verified, at a quarter of the size."""
    low = (shingles & U64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty(len(seeds), np.uint32)
    for i, (a, b) in enumerate(seeds):
        out[i] = ((low ^ b) * a).min()
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _seeds(n: int) -> np.ndarray:
    both = (mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32).reshape(n, 2)
    both[:, 0] |= np.uint32(1)
    return both


def signatures(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, version, n_shingles, high, low, signature): hash of every whole text, and
    size, 128-bit digest and MinHash values of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(s.values)
        for batch in batches:
            sizes, high, low, values = [], [], [], []
            for shingles in shingle_sets(batch.column(1).to_pylist(), s.words):
                digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8")
                sizes.append(len(shingles))
                high.append(digest[0])
                low.append(digest[1])
                values.append(minhash(shingles, seeds).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                    pa.array(values, pa.binary()),
                ],
                ["doc_id", "version", "n_shingles", "high", "low", "signature"],
            )

    source = texts(docs).withColumn("version", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, version long, n_shingles long, high long, low long, signature binary")


def band_keys(representatives: DataFrame, s: Settings) -> DataFrame:
    """(key, band, rep): one row per band of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, s.bands + 1, dtype=U64))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, s.bands, s.rows)
            key = np.zeros((n, s.bands), U64)
            for r in range(s.rows):
                key = mix(key + values[:, :, r].astype(U64) + U64(1)) ^ salt
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(s.bands, dtype=np.int32), n)),
                    pa.array(np.repeat(np.asarray(batch.column(0)), s.bands)),
                ],
                ["key", "band", "rep"],
            )

    return representatives.select("rep", "signature").mapInArrow(run, "key long, band int, rep long")


def cells_of(members: DataFrame, s: Settings) -> DataFrame:
    """Members of buckets with their ``n`` dealt to cells (key, i, j), i <= j: the
    block of a member meets every block of its bucket in one cell."""
    blocks = F.ceil(F.col("n") / s.block).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "blocks", "other")


def whole_cells(batches: Iterator[pa.RecordBatch], width: int = 3) -> Iterator[pa.Table]:
    """Tables of whole cells from batches sorted by the first ``width`` columns; the
    cell that a batch ends in waits for the next. A cell has a bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(c)) for c in range(width)]
        if held:
            last = held[-1]
            same = all(k[0] == last.column(c)[last.num_rows - 1].as_py() for c, k in enumerate(keys))
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        cut = 0
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows > 1 else []
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, width: int = 3) -> np.ndarray:
    keys = [table.column(c).to_numpy() for c in range(width)]
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return np.concatenate([[0], change, [table.num_rows]])


def candidate_pairs(values: np.ndarray, band: int, own: np.ndarray, i: int, j: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell whose first common band is this one and that no look at the
    posterior drops. Within one block all pairs, of two blocks those across."""
    if i == j:
        a, b = np.triu_indices(len(values), 1)
    else:
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = np.repeat(x, len(y)), np.tile(y, len(x))
    count = np.zeros(len(a), np.int16)
    for k, least in enumerate(least_matches(s)):
        part = values[:, k * s.step : (k + 1) * s.step]
        count += (part[a] == part[b]).sum(axis=1, dtype=np.int16)
        stay = count >= least
        a, b, count = a[stay], b[stay], count[stay]
    if band and len(a):
        head = values[:, : band * s.rows].reshape(len(values), band, s.rows)
        first = ~(head[a] == head[b]).all(axis=2).any(axis=1)
        a, b = a[first], b[first]
    return a, b


def proposed(cells: DataFrame, s: Settings) -> DataFrame:
    """(key, i, j, rep, partners): members of cells that have pairs left, with the
    members of the same cell that each must be verified against, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            bounds = _bounds(table)
            key, i, j, band, own, rep = (table.column(c).to_numpy() for c in ("key", "i", "j", "band", "own", "rep"))
            values = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(rep), s.values)
            at, partners = [], []
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                if y - x < 2:
                    continue
                a, b = candidate_pairs(values[x:y], int(band[x]), own[x:y], i[x], j[x], s)
                if not len(a):
                    continue
                order = np.argsort(a, kind="stable")
                a, b = a[order] + x, b[order] + x
                heads, first = np.unique(a, return_index=True)
                lists = dict(zip(heads.tolist(), np.split(rep[b], first[1:]), strict=True))
                for m in np.union1d(a, b).tolist():
                    at.append(m)
                    partners.append(lists.get(m, ()))
            if at:
                ends = np.cumsum([0, *map(len, partners)])
                flat = np.concatenate([np.asarray(p, np.int64) for p in partners])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[at]), pa.array(i[at]), pa.array(j[at]), pa.array(rep[at]),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
                    ],
                    ["key", "i", "j", "rep", "partners"],
                )

    ordered = cells.select("key", "i", "j", "band", "own", "rep", "signature")
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return dealt.mapInArrow(run, "key long, i int, j int, rep long, partners array<long>")


def verified(cells: DataFrame, s: Settings) -> DataFrame:
    """(rep, links, least): for members of cells (key, i, j, rep, partners, count,
    shingles) the documents linked to each in this cell and the least member
    connected to it. Similarities are exact, on the shingle sets."""

    def links(rep, partners, count, sets):
        place = {r: k for k, r in enumerate(rep.tolist())}
        sizes = np.array([len(x) for x in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = np.zeros(len(rep), np.int64)
        root = np.arange(len(rep))

        def top(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        mark = np.zeros(int(codes.max()) + 1, bool)
        for k, others in enumerate(partners):
            if not len(others):
                continue
            mark[codes[starts[k] : ends[k]]] = True
            others = np.array([place[r] for r in others])
            if len(others) * 4 > len(rep):
                shared = np.add.reduceat(mark[codes].astype(np.int32), starts)[others]
            else:
                shared = np.array([mark[codes[starts[o] : ends[o]]].sum() for o in others])
            mark[codes[starts[k] : ends[k]]] = False
            for o in others[shared >= s.threshold * (sizes[k] + sizes[others] - shared) - 1e-9]:
                total[k] += count[o]
                total[o] += count[k]
                x, y = top(k), top(o)
                root[max(x, y)] = min(x, y)
        return total, rep[[top(k) for k in range(len(rep))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            out = []
            bounds = _bounds(table)
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                cell = table.slice(x, y - x)
                rep, count = cell.column("rep").to_numpy(), cell.column("count").to_numpy()
                sets = [np.frombuffer(v, np.uint64) for v in cell.column("shingles").to_pylist()]
                out.append((rep, *links(rep, cell.column("partners").to_pylist(), count, sets)))
            rep, total, least = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(total), pa.array(least)], ["rep", "links", "least"])

    ordered = cells.select("key", "i", "j", "rep", "partners", "count", "shingles")
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return dealt.mapInArrow(run, "rep long, links long, least long")


def _sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(high, low, shingles): digest and sorted shingle hashes of texts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch.column(0).to_pylist(), s.words)]
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(x), "<i8") for x in found], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(found, pa.binary())], ["high", "low", "shingles"]
            )

    return docs.select("text").mapInArrow(run, "high long, low long, shingles binary")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the least node connected to each, from edges (a, b).

    Alternates large-star and small-star steps, each a minimum per node joined back
    to its edges, until nothing changes; every step is written to the shared
    folder. The number of steps grows with the logarithm of a component's
    diameter.
    """
    def star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbours move to the least one
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # smaller neighbours, and the node itself, move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        return small.select("e.a", "e.b").filter("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label)
    before = state(edges)
    while before[0]:
        edges = staged(star(edges), label)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def linked_rows(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, version, root, n_links, n_shingles) of every row: ``version`` is the hash
    of its text, ``root`` numbers the group that links connect.

    The nodes of all steps are the different shingle sets, numbered as they are
    written; ids play no part, so several texts of one id are several nodes.
    """
    marked = staged(signatures(docs, s), "shingles")
    same = marked.groupBy("high", "low").agg(F.count("*").alias("count"), F.min(F.struct("version", "signature")).alias("one"))
    classes = same.select(F.monotonically_increasing_id().alias("rep"), "high", "low", "count", "one.version", "one.signature")
    classes = staged(classes, "classes")
    reps = classes.filter("signature is not null").select("rep", "count", "signature")

    bands = band_keys(reps, s)
    buckets = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = bands.join(buckets, "key").join(reps.select("rep", "signature"), "rep")
    pairs = staged(proposed(cells_of(members, s), s), "cells")

    # without the broadcast all texts would cross the network for the few that have partners
    chosen = classes.join(pairs.select("rep").distinct(), "rep", "left_semi")
    needed = small(staged(chosen.select("version").distinct(), "verified-texts"), s.broadcast)
    wanted = texts(docs).select("text", F.xxhash64("text").alias("version")).join(needed, "version", "left_semi")
    sets = _sets(wanted, s).join(chosen.select("rep", "count", "high", "low"), ["high", "low"])
    sets = staged(sets.select("rep", "count", "shingles"), "sets").dropDuplicates(["rep"])
    found = staged(verified(pairs.join(sets, "rep"), s), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")), "components")
    by_class = (
        classes.select("rep", "high", "low", "count").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
        .select("high", "low", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"))
    )
    return marked.join(by_class, ["high", "low"]).select("doc_id", "version", "root", "n_links", "n_shingles")


def join(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, n_links, n_shingles) of every document.

    ``class_id`` is the least doc_id of the group that links connect, ``n_links``
    the number of other documents at or above the threshold, equal ones included.
    A text of fewer words than a shingle, but not none, is one shingle; texts
    without words equal each other; a null text has no words. A row without an id
    is linked like any other; its class is null if no row of its group has an id.
    Repeated rows stay repeated and count as copies; several texts of one id are
    linked each for itself. Ids may have any type with an order.
    """
    rows = staged(linked_rows(docs, s), "linked-rows")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "root").select("doc_id", "class_id", "n_links", "n_shingles")


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each group, the one of least id; all columns stay.

    Of several texts of that id in the group the one of least hash stays, and of rows
    that repeat both one. A group without ids keeps a row without one.
    """
    rows = linked_rows(docs.select("doc_id", "text"), s)
    rows = staged(rows.groupBy("root", "doc_id", "version").agg(F.count("*").alias("n")), "grouped-rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    first = rows.groupBy("root").agg(F.min(place).alias("first"))
    judged = rows.join(first, "root").withColumn("kept", place == F.col("first"))
    own = F.xxhash64(F.coalesce("text", F.lit("")))

    def matching(some: DataFrame, how: str, source: DataFrame) -> DataFrame:
        named = some.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"))
        return source.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (own == F.col("__version")), how)

    kept = matching(judged.filter(~F.coalesce("kept", F.lit(False))), "left_anti", docs)
    repeated = judged.filter("kept and n > 1")
    one = Window.partitionBy("doc_id", "text").orderBy("text")
    again = matching(repeated, "left_semi", kept).withColumn("__row", F.row_number().over(one)).filter("__row = 1").drop("__row")
    return matching(repeated, "left_anti", kept).unionByName(again)
