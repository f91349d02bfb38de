"""Phrase collocations: word sequences that occur more often than their parts suggest.

1. Words are counted per language, exactly and as strings.
2. Every shard of texts gives its windows, the sequence of up to ``longest`` words
   that starts at each place and ends at the end of the piece or before a word too
   rare to stand in a candidate. The sorted different windows become a count
   transducer: an acyclic automaton over words, built as they come, that gives every
   sequence the number of its occurrences.
3. Transducers are cut by prefix range (the first two words), so that every longer
   sequence has all its occurrences in one range. There the transducers of all
   shards are united and their weights summed; arcs that reach ``least`` are the
   candidates, and the weights along their path are the counts of their first parts.
4. The other parts are looked up in the united weights, the lowest cut scores, and
   a candidate inside a longer one of the same count goes.

A transducer is as large as the different windows of its shard; shards and ranges
are bounded by settings, and their number grows with the corpus.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, staged
from .hashing import U64, mix, word_spans

# What ends a piece and what parts words.
PIECE_END = b".,;:!?\n\x0b\x0c\r"
BLANK = b" \t"

_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_END)] = True
_PARTING = _ENDS.copy()
_PARTING[list(BLANK)] = True
_END = re.compile(rb"[" + re.escape(PIECE_END) + rb"]")
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    longest: int = 5
    least: int = 100  # occurrences of a candidate
    top: int = 2000  # phrases of a language in the report
    chunk: int = 1 << 20  # bytes of text read together
    shard: int = 1_000_000  # different windows of a transducer, about
    span: int = 4_000_000  # words of the corpus per prefix range, about
    broadcast: int = 32 << 20  # bytes of frequent words that may be broadcast; beyond, windows are not cut at rare words


# --- tokens -------------------------------------------------------------------------


def chunks(texts: Iterator[bytes], size: int) -> Iterator[bytes]:
    """Texts joined by the end of a piece; a longer one is cut where a piece ends."""
    held, total = [], 0
    for text in texts:
        at = 0
        while len(text) - at > size and (end := _END.search(text, at + size)):
            yield text[at : end.start()]
            at = end.end()
        held.append(text[at:])
        total += len(held[-1]) + 1
        if total > size:
            yield b"\n".join(held)
            held, total = [], 0
    if held:
        yield b"\n".join(held)


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts, ends and piece numbers of the words of a chunk."""
    raw = np.frombuffer(data, np.uint8)
    hashes, starts, ends = word_spans(raw, _PARTING)
    stops = np.flatnonzero(_ENDS[raw])
    return hashes, starts, ends, np.searchsorted(stops, starts)


def by_language(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(language, chunk) of batches (lang, text), A-Z lower-cased."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text.encode().lower())
        for lang, texts in held.items():
            for chunk in chunks(iter(texts), size):
                yield lang, chunk


def word_counts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(lang, word, f) of all different words of ``docs`` (lang, text)."""
    limit = s.shard // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[int, list]] = {}
        size = 0

        def rows():
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(words), pa.string()), pa.array([w for w, _ in words.values()], pa.string()),
                        pa.array([n for _, n in words.values()], pa.int64()),
                    ],
                    ["lang", "word", "n"],
                )

        for lang, chunk in by_language(batches, s.chunk):
            hashes, starts, ends, _ = tokens(chunk)
            different, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            words = seen.setdefault(lang, {})
            size -= len(words)
            for h, k, n in zip(different.tolist(), first.tolist(), counts.tolist(), strict=True):
                known = words.get(h)
                if known is None:
                    words[h] = [chunk[starts[k] : ends[k]].decode(), n]
                else:
                    known[1] += n
            size += len(words)
            if size > limit:
                yield from rows()
                seen, size = {}, 0
        yield from rows()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("f"))


def hashed(words: DataFrame) -> DataFrame:
    """(lang, hash, word, f) of words (lang, word, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tokens("\n".join(batch.column(1).to_pylist()).encode())[0].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(1), batch.column(2)], ["lang", "hash", "word", "f"])

    return words.select("lang", "word", "f").mapInArrow(run, "lang string, hash long, word string, f long")


@dataclass(frozen=True)
class Frequent:
    """Frequent words of a language: hashes in order, and the rank of each by count."""

    hashes: np.ndarray
    ranks: np.ndarray

    def ranked(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are frequent, and the ranks of those."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        return there, self.ranks[at[there]]

    def by_rank(self) -> np.ndarray:
        out = np.empty_like(self.hashes)
        out[self.ranks.astype(np.int64)] = self.hashes
        return out


def frequent_words(known: DataFrame) -> dict[str, Frequent]:
    """The frequent words (lang, hash, f) of each language; the caller bounds their number."""
    table = known.select("lang", "hash", "f").toArrow()
    langs, hashes, counts = (table.column(k).to_numpy() for k in range(3))
    out = {}
    for name in set(langs.tolist()):
        rows = np.flatnonzero(langs == name)
        h, f = hashes[rows].view(U64), counts[rows]
        order = np.argsort(h)
        h, f = h[order], f[order]
        ranks = np.empty(len(h), U64)
        ranks[np.lexsort((h, -f))] = np.arange(len(h), dtype=U64)
        out[name] = Frequent(h, ranks)
    return out


# --- transducers --------------------------------------------------------------------


@dataclass
class Counts:
    """Different windows, sorted: ids into ``words`` (sorted hashes, or ranks of frequent
    words) plus 1, 0 behind the end of a shorter window, and how often each occurs."""

    words: np.ndarray
    windows: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.weights)


def summed(words: np.ndarray, windows: np.ndarray, weights: np.ndarray) -> Counts:
    """Windows sorted, equal ones once with the sum of their weights."""
    width, base = windows.shape[1], U64(len(words) + 1)
    pairs = [
        windows[:, k].astype(U64) * base + (windows[:, k + 1] if k + 1 < width else 0) for k in range(0, width, 2)
    ]
    order = np.lexsort(pairs[::-1])
    windows, weights = windows[order], weights[order]
    if not len(order):
        return Counts(words, windows, weights)
    first = np.concatenate([[True], np.any([p[order][1:] != p[order][:-1] for p in pairs], axis=0)])
    at = np.flatnonzero(first)
    return Counts(words, windows[at], np.add.reduceat(weights, at))


def united(parts: list[Counts]) -> Counts:
    """Union of several, weights of equal windows summed."""
    if len(parts) == 1:
        return parts[0]
    words = reduce(np.union1d, (p.words for p in parts))
    moved = [np.concatenate([[0], np.searchsorted(words, p.words) + 1]).astype(np.uint32)[p.windows] for p in parts]
    return summed(words, np.concatenate(moved), np.concatenate([p.weights for p in parts]))


def windows_of(hashes: np.ndarray, runs: np.ndarray, longest: int) -> Counts:
    """Windows of two words or more of a sequence of words; none crosses runs."""
    words, ids = np.unique(hashes, return_inverse=True)
    ids = (ids + 1).astype(np.uint32)
    n = len(ids)
    windows = np.zeros((n, longest), np.uint32)
    windows[:, 0] = ids
    for k in range(1, longest):
        inside = runs[k:] == runs[: n - k]
        windows[: n - k, k][inside] = ids[k:][inside]
    windows = windows[windows[:, 1] > 0]
    return summed(words, windows, np.ones(len(windows), np.int64))


def levels(c: Counts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length k the sequences of k words that windows begin with: the row of
    the first window, the number of the shorter sequence they prolong, and the count."""
    out, before = [], np.zeros(len(c), np.int64)
    new = np.zeros(len(c), bool)
    if len(c):
        new[0] = True
    for k in range(c.windows.shape[1]):
        column = c.windows[:, k]
        new = new.copy()
        new[1:] |= column[1:] != column[:-1]
        heads = np.flatnonzero(new)
        weight = np.add.reduceat(c.weights, heads) if len(heads) else np.zeros(0, np.int64)
        there = column[heads] > 0
        out.append((heads[there], before[heads[there]], weight[there]))
        number = np.cumsum(there) - 1
        before = number[np.cumsum(new) - 1]
    return out


def packed(c: Counts) -> bytes:
    """The windows as a transducer: for each depth the labels of the arcs in order, how
    many arcs leave the state behind each, and how many windows end there. As windows
    come sorted, a state is complete when the next one begins, and its arcs follow those
    of the state before. States without arcs are one and take no room."""
    used, ids = np.unique(c.windows, return_inverse=True)
    padded = int(len(used) > 0 and used[0] == 0)
    words = c.words[used[padded:].astype(np.int64) - 1]
    labels = ids.reshape(c.windows.shape) - padded
    depth = levels(c)
    out = []
    for k, (heads, _, weight) in enumerate(depth):
        parents = depth[k + 1][1] if k + 1 < len(depth) else np.zeros(0, np.int64)
        deeper = depth[k + 1][2] if k + 1 < len(depth) else np.zeros(0, np.int64)
        arcs = np.bincount(parents, minlength=len(heads))
        end = weight - np.bincount(parents, deeper, len(heads)).astype(np.int64)
        out.append((labels[heads, k], arcs, end))
    steps = np.diff(words, prepend=U64(0))
    return zstandard.ZstdCompressor(3).compress(pickle.dumps((_planes(steps), [[_planes(a) for a in part] for part in out]), protocol=5))


def _planes(a: np.ndarray) -> list[bytes]:
    """Numbers as bytes of equal weight, as many as the largest needs: high ones repeat."""
    wide = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = 8 - next((k for k in range(8) if wide[:, 7 - k].any()), 8)
    return [len(a).to_bytes(8, "little"), *(wide[:, k].tobytes() for k in range(used))]


def _numbers(planes: list[bytes]) -> np.ndarray:
    out = np.zeros(int.from_bytes(planes[0], "little"), np.int64)
    for k, plane in enumerate(planes[1:]):
        out |= np.frombuffer(plane, np.uint8).astype(np.int64) << (8 * k)
    return out


def unpacked(data: bytes) -> Counts:
    steps, depth = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    words = np.cumsum(_numbers(steps).view(U64))
    depth = [[_numbers(a) for a in part] for part in depth]
    width = len(depth)
    windows = np.zeros((1, width), np.uint32)
    parent = np.zeros(len(depth[0][0]), np.int64)
    out = []
    for k, (labels, arcs, end) in enumerate(depth):
        windows = windows[parent]
        windows[:, k] = labels + 1
        out.append((windows[end > 0], end[end > 0]))
        parent = np.repeat(np.arange(len(arcs)), arcs)
    return summed(words, np.concatenate([w for w, _ in out]), np.concatenate([n for _, n in out]))


def transducers(docs: DataFrame, ranges: int, frequent: Broadcast | None, s: Settings = Settings()) -> DataFrame:
    """(lang, part, automaton) of ``docs`` (lang, text): transducers of shards, cut by
    prefix range. ``frequent``: the frequent words per language, by which words are
    known and before others of which windows end. None: words are known by their
    hashes and no window is cut."""

    def cut(lang: str, c: Counts) -> Iterator[pa.RecordBatch]:
        if not len(c):
            return
        pair = c.words[c.windows[:, 0].astype(np.int64) - 1] * U64(3) + c.words[c.windows[:, 1].astype(np.int64) - 1]
        part = (mix(pair) % U64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        parts, first = np.unique(part[order], return_index=True)
        blobs = [packed(Counts(c.words, c.windows[rows], c.weights[rows])) for rows in np.split(order, first[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(parts), pa.string()), pa.array(parts), pa.array(blobs, pa.binary())], ["lang", "part", "automaton"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if frequent is None else frequent.value
        held: dict[str, list] = {}  # words waiting to be windows
        made: dict[str, list[Counts]] = {}

        def flush(lang: str) -> None:
            hashes, runs = zip(*held.pop(lang), strict=True)
            shift, moved = 0, []
            for r in runs:
                moved.append(r + shift)
                shift += int(r[-1]) + 1 if len(r) else 0
            made.setdefault(lang, []).append(windows_of(np.concatenate(hashes), np.concatenate(moved), s.longest))
            if len(made[lang]) > 1:
                made[lang] = [united(made[lang])]

        for lang, chunk in by_language(batches, s.chunk):
            hashes, _, _, piece = tokens(chunk)
            if known is not None:
                if lang not in known:
                    continue
                there, hashes = known[lang].ranked(hashes)
                piece = (piece + np.cumsum(~there))[there]
            if not len(hashes):
                continue
            held.setdefault(lang, []).append((hashes, piece))
            if sum(len(h) for h, _ in held[lang]) > s.shard:
                flush(lang)
                if len(made[lang][0]) > s.shard:
                    yield from cut(lang, made.pop(lang)[0])
        for lang in list(held):
            flush(lang)
        for lang, (c,) in made.items():
            yield from cut(lang, c)

    return docs.select("lang", "text").mapInArrow(run, "lang string, part long, automaton binary")


def frequent_sequences(automata: DataFrame, ranges: int, frequent: Broadcast | None, s: Settings = Settings()) -> DataFrame:
    """(lang, words, f, firsts): sequences of two words or more that occur ``least``
    times, as word hashes, with the counts of their first 2, 3, ... words."""

    def found(lang: str, c: Counts) -> pa.RecordBatch:
        words, counts, firsts = [], [], []
        path: np.ndarray | None = None  # counts along the path, by sequence of the length before
        named = c.words if frequent is None else frequent.value[lang].by_rank()[c.words.astype(np.int64)]
        hashes = np.concatenate([[U64(0)], named]).view(np.int64)
        for k, (heads, parent, weight) in enumerate(levels(c)):
            if k == 0:
                path = np.zeros((len(heads), 0), np.int64)
                continue
            path = path[parent]
            keep = np.flatnonzero(weight >= s.least)
            words += hashes[c.windows[heads[keep], : k + 1]].tolist()
            counts += weight[keep].tolist()
            firsts += path[keep].tolist()
            path = np.concatenate([path, weight[:, None]], axis=1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(words), pa.string()), pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.int64()),
                pa.array(firsts, pa.list_(pa.int64())),
            ],
            ["lang", "words", "f", "firsts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, waiting = None, [], 0
        for batch in batches:
            for lang, part, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (lang, part) != at:
                    if at is not None:
                        yield found(at[0], united(parts))
                    at, parts, waiting = (lang, part), [], 0
                parts.append(unpacked(data))
                waiting += len(parts[-1])
                if len(parts) > 2 and waiting > max(len(parts[0]), s.shard // 4):
                    parts, waiting = [united(parts)], 0
        if at is not None:
            yield found(at[0], united(parts))

    dealt = automata.repartition(ranges, "lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(run, "lang string, words array<long>, f long, firsts array<long>")


# --- scores -------------------------------------------------------------------------


def exact_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) without rounding: products have up to 38 digits."""
    wide = "cast({} as decimal(19, 0))"
    return F.expr(f"({wide.format(f'1000 * {a}')} * {wide.format(n)}) div ({wide.format(left)} * {wide.format(right)})")


def scored(sequences: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, n, score) of every sequence, at its lowest cut."""
    weights = sequences.select("lang", "words", "f").unionByName(words.select("lang", F.array("hash").alias("words"), "f"))
    size = F.size("words")
    cuts = sequences.select("lang", "words", F.col("f").alias("a"), "firsts", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "words", "a", "k", F.get("firsts", F.col("k") - 2).alias("l"), F.get("words", F.lit(0)).alias("first"),
        F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"),
    )
    # first parts of two words or more are known from the path
    single = words.select("lang", F.col("hash").alias("first"), F.col("f").alias("single"))
    cuts = cuts.join(single, ["lang", "first"])
    cuts = cuts.join(weights.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("l", F.coalesce("l", "single")).join(totals, "lang")
    lowest = F.min(F.struct(exact_score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("cut")
    every = cuts.groupBy("lang", "words", "a", "n").agg(lowest)
    return every.select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def inside_longer(sequences: DataFrame) -> DataFrame:
    """(lang, words, longer): sequences that lie in longer ones, with the highest
    count of those."""
    size = F.size("words")
    places = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m)
    )))
    parts = sequences.filter(size > 2).select("lang", "f", F.explode(F.array_distinct(places)).alias("words"))
    return parts.groupBy("lang", "words").agg(F.max("f").alias("longer"))


def first_of_each(df: DataFrame, order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """The first n rows of each language with their ``rank``: first of each part of a
    language, so that no task ranks more than ``salts`` times n rows for a whole one."""
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    some = df.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(salts))).withColumn("rank", F.row_number().over(part))
    whole = Window.partitionBy("lang").orderBy(*order)
    return some.filter(F.col("rank") <= n).withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= n)


def collocations(docs: DataFrame, s: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A null language is ``und``; a null text is empty, and like one without words it
    counts nothing. Repeated rows count as often as they stand there. No rows, or no
    phrase of ``least`` occurrences: no rows. Other columns are not read. Words are
    told apart by 64 bits, phrases by those of their words.
    """
    spark = prepare(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = staged(word_counts(source, s), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = staged(hashed(words.filter(F.col("f") >= s.least)), "frequent-words")
    frequent = None
    if 16 * known.count() <= s.broadcast:  # a hash and a rank each
        frequent = spark.sparkContext.broadcast(frequent_words(known))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-(totals.agg(F.sum("n")).first()[0] or 0) // s.span), 1)
    automata = transducers(source, ranges, frequent, s)
    sequences = staged(frequent_sequences(automata, ranges, frequent, s), "sequences")
    if frequent is not None:
        frequent.unpersist()

    every = scored(sequences, known, totals).join(inside_longer(sequences), ["lang", "words"], "left")
    every = staged(every.filter(F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).drop("longer"), "scores")
    spelled = every.select("lang", "words", F.posexplode("words").alias("at", "hash")).join(known.select("lang", "hash", "word"), ["lang", "hash"])
    spelled = spelled.groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = every.join(spelled.select("lang", "words", F.array_join("w.word", " ").alias("phrase")), ["lang", "words"])
    best = first_of_each(named, [F.desc("score"), F.desc("a"), F.asc("phrase")], s.top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
