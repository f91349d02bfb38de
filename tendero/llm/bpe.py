"""Byte-level BPE: exact encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has exactly one encoding, hence one last token. Going
through the prefixes in order, an automaton over the vocabulary yields all tokens
that end there; the one whose left neighbour (the last token of the remaining
prefix) may stand before it is the prefix's last token. Two tokens may stand side
by side if merging their joined text would give the two again, which is tested by
undoing merges from both sides of the seam. Back-pointers give the ids.

No merge queue, no dependence on the order of merges within a piece, and the time
for a piece is linear in its length times the token matches per position.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, staged, texts

# The pieces a text is cut into before merging, as byte-level BPE
# vocabularies define them.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# A mark after letters is a piece by itself; an apostrophe may be more.
MARKS = frozenset(".,;:!?)")

CACHE_PIECES = 80_000  # a worker that held 60 MB before took 190 MB after 16 million characters (209 with twice as many)


def byte_letters() -> list[str]:
    """The printable letter a byte-level vocabulary writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


def bytes_by_id(file: dict) -> list[bytes]:
    """The bytes of every token of a vocabulary file; special tokens stand for their text."""
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    vocab = file["model"]["vocab"]
    special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
    out = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        if token not in special:
            out[i] = bytes(byte_of[x] for x in token)
    for token, i in special.items():
        out[i] = token.encode()
    return out


class Vocabulary:
    """Tokens of a byte-level BPE file: bytes by id, and how each was merged."""

    def __init__(self, text: str):
        file = json.loads(text)
        vocab = file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.bytes = bytes_by_id(file)
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        #: rank of a merge and the token it makes, by (left id, right id)
        self.rank: dict[tuple[int, int], int] = {}
        #: the two halves a token was merged from, with the rank of that merge
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), rank)
            self.halves.setdefault(whole, (left, right, rank))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None


class Encoder:
    """Encodes pieces of text with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.auto = ahocorasick.Automaton()
        special = set(v.special.values())
        for i, token in enumerate(v.bytes):
            if token and i not in special:
                self.auto.add_word(token.decode("latin-1"), (i, len(token)))
        self.auto.make_automaton()
        self.words_of = [np.array([i], "<i4").tobytes() for i in range(len(v.bytes))]
        self.fits: dict[int, bool] = {}
        self.pieces = regex.compile(PIECES)
        self.gaps = regex.compile(r"\s\s")
        self.cache = Generations(self.after_blank, CACHE_PIECES)
        self.words = Generations(self.merge, 2 * CACHE_PIECES)

    def forget(self) -> None:
        """Empty the caches: a worker outlives its task, and the next one may need the memory."""
        for cache in (self.cache, self.words, self.fits):
            cache.clear()
        self.cache.old = self.words.old = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of left + right as one text is the pair itself.

        Undo merges on both sides of the seam, the later one first. If two tokens
        touching the seam would have merged earlier than the merges that hold
        them apart, the pair cannot stand.
        """
        halves, rank = self.v.halves, self.v.rank
        limit = len(rank) + 1
        while True:
            if rank.get((left, right), limit) < limit:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            # ranks tell which of the two was formed later; equal ranks form left to right
            if b is None or (a is not None and a[2] > b[2]):
                limit, left = a[2], a[1]
            else:
                limit, right = b[2] + 1, b[0]

    def merge(self, piece: str) -> bytes:
        """Ids of one piece, as little-endian int32 bytes."""
        data = piece if piece.isascii() else piece.encode().decode("latin-1")
        n = len(data)
        last = [-1] * n + [0]  # by the end of a prefix; the empty prefix stands at -1
        back = [0] * n
        fits, done = self.fits, -1
        for end, (token, size) in self.auto.iter(data):
            # matches of one end come longest first; the first that fits is the only one
            if end == done:
                continue
            start = end - size
            if start >= 0:
                before = last[start]
                if before < 0:
                    continue
                key = (before << 24) + token
                fit = fits.get(key)
                if fit is None:
                    fit = fits[key] = self.compatible(before, token)
                if not fit:
                    continue
            last[end] = token
            back[end] = start
            done = end
        out, words, end = [], self.words_of, n - 1
        while end >= 0:
            if last[end] < 0:
                raise ValueError("the vocabulary lacks bytes of the text")
            out.append(words[last[end]])
            end = back[end]
        out.reverse()
        return b"".join(out)

    def piece(self, text: str) -> bytes:
        """Ids of a text that holds no special token."""
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        return b"".join(self.words.get_all(self.pieces.findall(text)))

    def after_blank(self, word: str) -> bytes:
        """Ids of a blank and what follows it up to the next one. Most are letters with
        at most one mark behind them; what the pattern cuts there is known without it."""
        if word.isascii():
            if word.isalpha():
                self.words.turn()
                return self.words[" " + word]
            if word[-1:] in MARKS and word[:-1].isalpha():
                self.words.turn()
                return self.words[" " + word[:-1]] + self.words[word[-1]]
        return self.piece(" " + word)

    def plain(self, text: str) -> bytes:
        """As ``piece``; a text in which white space never meets white space may be
        cut at its blanks, since each blank then belongs to what follows it."""
        if not text or text[0].isspace() or text[-1].isspace() or self.gaps.search(text):
            return self.piece(text)
        first, *rest = text.split(" ")
        return self.piece(first) + b"".join(self.cache.get_all(rest))

    def encode(self, text: str) -> bytes:
        if self.v.specials is None or not self.v.specials.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.v.specials.finditer(text):
            out.append(self.plain(text[at : m.start()]))
            out.append(np.array([self.v.special[m[0]]], "<i4").tobytes())
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


_ENCODERS: dict[str, Encoder] = {}
_TOKENS: dict[str, pa.Array] = {}


def encoder(vocabulary: str) -> Encoder:
    """The encoder of a vocabulary file's content, made once in a worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = Encoder(Vocabulary(vocabulary))
    return _ENCODERS[vocabulary]


def token_bytes(vocabulary: str) -> pa.Array:
    """Bytes by id; all that decoding needs of a vocabulary."""
    if vocabulary not in _TOKENS:
        _TOKENS.clear()
        file = json.loads(vocabulary)
        _TOKENS[vocabulary] = pa.array(bytes_by_id(file), pa.large_binary())
    return _TOKENS[vocabulary]


def decode_ids(tokens: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts of concatenated id lists; bytes that are no UTF-8 become U+FFFD."""
    joined = tokens.take(pa.array(ids, pa.int32()))
    if not len(ids):
        return [""] * len(ends)
    offsets = np.frombuffer(joined.buffers()[1], np.int64, len(ids) + 1, joined.offset * 8)
    data = memoryview(joined.buffers()[2] or b"")
    cuts = offsets[np.concatenate([[0], ends])]
    return [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every whole text with the vocabulary file at ``path``.

    A null text counts as empty and has no ids; repeated rows stay repeated;
    columns other than doc_id and text are left out.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:  # a vocabulary of fixed size, shipped to the workers once
        vocabulary = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary.value)
        for batch in batches:
            parts = [coder.encode(text) for text in batch.column(1).to_pylist()]
            ends = np.cumsum([len(p) // 4 for p in parts], dtype=np.int32)
            ids = np.frombuffer(b"".join(parts), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])
        coder.forget()
        pa.default_memory_pool().release_unused()

    source = texts(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text added as ``decoded``."""
    spark = encoded.sparkSession
    with open(path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(vocabulary.value)
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets)
            ids = np.asarray(lists.values)[offsets[0] : offsets[-1]]
            decoded = decode_ids(tokens, ids, offsets[1:] - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
        pa.default_memory_pool().release_unused()

    source = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Counts and digests of the ids and of the decoded text of every document.

    The ids are written and read again: in one stage every task would keep two Python
    workers, one with the encoder and one with the decoder, beside the JVM heap.
    """
    both = decode(staged(encode(docs, path), "token-ids", compression="zstd"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
