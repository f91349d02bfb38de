"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only as far as the threshold of ``depth`` bytes, by passes
over digits from the most significant one. After each pass a suffix that is alone
in its group leaves; suffixes still together after the last one are exactly the
windows of ``depth`` bytes that occur more than once.

The digits are chosen so that neighbouring suffixes can travel together:

1. The first digit is a string of ``gram`` bytes inside the window, the one of
   least hash, with its offset. Equal windows choose alike. A run of neighbouring
   suffixes shares one place, so a text gives a row per run, about two in
   ``depth - gram`` bytes, and not one per suffix.
2. The second digit is the whole stretch of text a run covers. Runs that are equal
   are equal in all their suffixes, which settles copies of any length.
3. Different runs with a first digit in common, one row per different run however
   often it occurs, are cut into blocks of a few suffixes. The bytes that all of a
   block share are the next digit; after it, blocks that are equal are settled.
4. What is left, the ends of repeated stretches, is unfolded into suffixes, and all
   bytes up to the threshold are the last digit.

Digits are compared by hashes: the last two, which decide, by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import BROADCAST_BYTES, row_bytes, small, staged, texts
from .hashing import _BYTE, U64, mix, powers

SEGMENT = 1 << 18  # suffixes handled at once; runs end at its borders
_PLACE = U64((1 << 20) - 1)
BLOCK = StructType([
    *(StructField(c, LongType()) for c in ("core_high", "core_low", "hull_high", "hull_low")),
    StructField("alone", BooleanType()),
    *(StructField(c, LongType()) for c in ("first", "last", "doc_id", "version")),
])


@dataclass(frozen=True)
class Settings:
    depth: int = 400
    gram: int = 96
    block: int = 16
    broadcast_rows: int = 1_000_000  # groups that may be broadcast; more are joined by shuffle
    broadcast_spans: int = 4_000_000


def runs(data: bytes, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first digit, place of it, first suffix, last suffix) of all runs of a text, by segment."""
    n = len(data) - s.depth + 1
    width = s.depth - s.gram + 1
    for at in range(0, n, SEGMENT):
        part = np.frombuffer(data, np.uint8, min(SEGMENT, n - at) + s.depth - 1, at)
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        grams = mix((sums[s.gram :] - sums[: -s.gram]) * down[: len(part) - s.gram + 1])
        # hash above, place below: the least is the leftmost of least hash
        keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
        padded = np.full(-(-len(keyed) // width) * width, np.iinfo(U64).max, U64)
        padded[: len(keyed)] = keyed
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(keyed) - width + 1
        place = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:] - 1, [count - 1]])
        where = place[first]
        yield grams[where].view(np.int64), where + at, first + at, last + at


def digests_of(parts: list) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def first_digits(docs: DataFrame, s: Settings) -> DataFrame:
    """(gram, high, low, place, first, last, doc_id, version): all runs of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            owner = []
            for k, text in enumerate(batch.column(2).to_pylist()):
                data = text.encode()
                view = memoryview(data)
                for gram, place, first, last in runs(data, s) if len(data) >= s.depth else ():
                    high, low = digests_of([view[a:b] for a, b in zip(first.tolist(), (last + s.depth).tolist(), strict=True)])
                    for c, v in zip(columns, (gram, high, low, place, first, last), strict=True):
                        c.append(v)
                    owner.append(np.full(len(gram), k))
            if owner:
                who = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.concatenate(c), pa.int64()) for c in columns), batch.column(0).take(who), batch.column(1).take(who)],
                    ["gram", "high", "low", "place", "first", "last", "doc_id", "version"],
                )

    return versions(docs).mapInArrow(
        run, "gram long, high long, low long, place long, first long, last long, doc_id long, version long"
    )


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text); ``version`` tells texts of one id apart."""
    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def by_document(docs: DataFrame, lists: DataFrame, how: str, s: Settings) -> DataFrame:
    """Texts joined with a written list per document, broadcast if it is short."""
    held = lists.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "items")
    size = lists.agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items")).first()
    fits = size.n * row_bytes(held) + (size.items or 0) * 16 <= BROADCAST_BYTES
    if fits and size.n <= s.broadcast_rows and (size.items or 0) <= s.broadcast_spans:
        held = F.broadcast(held)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__version"))
    return versions(docs).join(held, same, how).drop("__id", "__version")


def blocks(docs: DataFrame, lists: DataFrame, s: Settings) -> DataFrame:
    """(core_high, core_low, hull_high, hull_low, alone, first, last, doc_id, version):
    listed runs cut into blocks of suffixes, where ``items`` lists struct(place, first,
    last, alone).

    Blocks are aligned to the distance from the first digit, so equal suffixes are in
    like blocks. The core is what all suffixes of a block have in common, the hull
    what they cover together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores, hulls, rest = [], [], []
            for i, version, text, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for x in items:
                    place, near, far = x["place"], x["place"] - x["last"], x["place"] - x["first"]
                    for b in range(near // s.block, far // s.block + 1):
                        low, high = max(near, b * s.block), min(far, (b + 1) * s.block - 1)
                        cores.append(data[place - b * s.block : place - (b + 1) * s.block + 1 + s.depth] + bytes([b % 256, b // 256]))
                        hulls.append(data[place - high : place - low + s.depth] + bytes([low % 256, low // 256]))
                        rest.append((x["alone"], place - high, place - low, i, version))
            if rest:
                kinds = [pa.bool_(), *[pa.int64()] * 4]
                columns = [pa.array(c, k) for c, k in zip(zip(*rest, strict=True), kinds, strict=True)]
                digests = [pa.array(d) for part in (cores, hulls) for d in digests_of(part)]
                yield pa.RecordBatch.from_arrays([*digests, *columns], BLOCK.names)

    found = by_document(docs, lists, "inner", s).select("doc_id", "version", "text", "items")
    return found.mapInArrow(run, BLOCK)


def unfolded(docs: DataFrame, lists: DataFrame, s: Settings) -> DataFrame:
    """(high, low, alone, at, doc_id, version): the suffixes of listed blocks with a
    digest of all their bytes up to the threshold. ``items`` lists struct(first,
    last, alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, version, text, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view = memoryview(text.encode())
                places = np.concatenate([np.arange(x["first"], x["last"] + 1) for x in items])
                alone = np.concatenate([np.full(x["last"] + 1 - x["first"], x["alone"]) for x in items])
                for at in range(0, len(places), SEGMENT):
                    part = places[at : at + SEGMENT]
                    high, low = digests_of([view[p : p + s.depth] for p in part.tolist()])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(high), pa.array(low), pa.array(alone[at : at + SEGMENT]), pa.array(part),
                            pa.array([i] * len(part), pa.int64()), pa.array([version] * len(part), pa.int64()),
                        ],
                        ["high", "low", "alone", "at", "doc_id", "version"],
                    )

    found = by_document(docs, lists, "inner", s).select("doc_id", "version", "text", "items")
    return found.mapInArrow(run, "high long, low long, alone boolean, at long, doc_id long, version long")


def repeated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, version, items): for each document the maximal stretches of bytes that
    repeated windows cover, as struct(first, end), in order."""
    every = staged(first_digits(docs, s), "runs")
    # pass 1: grams that occur once take their suffixes along
    together = staged(every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")
    together = small(together, s.broadcast_rows)
    left = staged(every.join(together, "gram"), "runs-left")
    # pass 2: equal runs
    kinds = left.groupBy("gram", "high", "low").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "place", "first", "last")).alias("one")
    )
    kinds = staged(kinds, "runs-kinds")
    settled = left.join(kinds.filter("n > 1").select("gram", "high", "low"), ["gram", "high", "low"]).select(
        "doc_id", "version", "first", (F.col("last") + s.depth).alias("end")
    )
    # pass 3: different runs that share the gram, where any run is alone, block by block
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    lists = kinds.join(mixed.select("gram"), "gram").select("one.*", (F.col("n") == 1).alias("alone"))
    lists = lists.groupBy("doc_id", "version").agg(F.collect_list(F.struct("place", "first", "last", "alone")).alias("items"))
    cut = staged(blocks(docs, staged(lists, "runs-mixed"), s), "blocks")
    # a block without its core elsewhere has no suffix elsewhere; one with its hull elsewhere has all of them there
    hulls = cut.groupBy("core_high", "core_low", "hull_high", "hull_low").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "first", "last")).alias("one"), F.min("alone").alias("alone")
    )
    hulls = staged(hulls, "blocks-hulls")
    hull = ["core_high", "core_low", "hull_high", "hull_low"]
    equal_blocks = cut.filter("alone").join(hulls.filter("n > 1").select(*hull), hull).select(
        "doc_id", "version", "first", (F.col("last") + s.depth).alias("end")
    )
    # pass 4: suffixes of different blocks that share the core
    unlike = hulls.groupBy("core_high", "core_low").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core_high", "core_low")
    lists = hulls.join(unlike, ["core_high", "core_low"]).select("one.*", ((F.col("n") == 1) & F.col("alone")).alias("alone"))
    lists = lists.groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "last", "alone")).alias("items"))
    suffixes = staged(unfolded(docs, staged(lists, "blocks-unlike"), s), "suffixes")
    equal = suffixes.groupBy("high", "low").agg(F.count("*").alias("n")).filter("n > 1").select("high", "low")
    equal_suffixes = suffixes.filter("alone").join(equal, ["high", "low"]).select(
        "doc_id", "version", F.col("at").alias("first"), (F.col("at") + s.depth).alias("end")
    )
    every = settled.unionByName(equal_blocks).unionByName(equal_suffixes)
    lists = every.groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "end")).alias("items"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[{"first": a, "end": b} for a, b in merged(items)] for items in batch["items"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "version": batch["version"], "items": spans})

    return lists.mapInPandas(run, "doc_id long, version long, items array<struct<first: long, end: long>>")


def merged(items: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that any of the stretches covers."""
    out: list[list[int]] = []
    for a, b in sorted((x["first"], x["end"]) for x in items):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) of every document: the bytes of its UTF-8 text
    that no repeated window covers, and the removed spans, struct(first, end).

    A null text is empty; a text shorter than the threshold has no window. Every
    occurrence of a repeated string goes, also within one text and in rows that
    repeat an id. Cuts fall between bytes, so ``kept`` is binary. Ids are integers; one
    of another type is cast, and what is no number is an error (null outside ANSI mode).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, spans = [], [], []
            for text, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                cuts = [(x["first"], x["end"]) for x in items or []]
                ends = [0, *(b for _, b in cuts)]
                starts = [*(a for a, _ in cuts), len(data)]
                sizes.append(len(data))
                kept.append(b"".join(data[a:b] for a, b in zip(ends, starts, strict=True)))
                spans.append([{"first": a, "end": b} for a, b in cuts])
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)],
                ["doc_id", "n_bytes", "kept", "spans"],
            )

    found = by_document(docs, staged(repeated(docs, s), "stretches"), "left", s)
    return found.select("doc_id", "text", "items").mapInArrow(
        run, "doc_id long, n_bytes long, kept binary, spans array<struct<first: long, end: long>>"
    )


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Sizes of every document and of what was removed, and a digest of what is kept."""
    return dedup(docs, s).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
