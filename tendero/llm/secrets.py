"""Secrets in texts: known shapes, and strings that no dictionary compresses.

Known shapes are found by pattern. Beyond them, every token of twelve characters or
more in the neighbourhood of a word such as "auth" or "credential", on either side,
is weighed by zstandard: how many bytes does it add to the compressed code around
it, with a dictionary of identifiers, key names and common words primed? Names and
prose are cheap; a random string costs almost as much as it is long, and is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

# The known shapes, in the order of their kinds, with the least
# length of a match (for ``assign`` of its second group).
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Context that makes a string worth weighing, and what may hold a secret.
SENSITIVE = re.compile(r"(?i:auth|bearer|credential|private|signature|cookie|session|passphrase|access|secret|token|key)", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_~-]{12,}={0,2}")  # below that, the frame of the compressor outweighs the string
# What may be a word of a language the dictionary does not hold is weighed from this length on.
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
LONG_WORD = 20
REACH = 48  # code points before or after a candidate in which a sensitive word must stand
AROUND = 400  # code points of surrounding text the compressor has seen

IDENTIFIERS = " ".join(
    f"{a}{sep}{b}"
    for sep in ("_", "-", "")
    for a in ("access", "api", "auth", "client", "user", "session", "private", "public", "request", "response")
    for b in ("key", "token", "secret", "id", "name", "value", "header", "config", "signature", "password")
) + " https://www.example.com/index.html?page= abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
# Endings and beginnings that long ordinary words are made of.
COMMON = (
    " international information administration representation communication implementation authentication authorization"
    " configuration documentation understanding requirements environmental development responsibility characteristics"
    " organization application approximately unfortunately significantly particularly independent experience government"
)


@dataclass(frozen=True)
class Settings:
    novelty: float = 0.8  # marginal compressed bytes per byte of a candidate
    level: int = 19


def assigned(text: str) -> list[tuple[int, int]]:
    low = text.lower()  # may differ in length; only asked whether a word occurs
    if not any(w in low for w in ASSIGN_WORDS):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]


def known(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known shapes, leftmost and not overlapping within a kind."""
    out = [(a, b, "assign") for a, b in assigned(text)]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


class Novelty:
    """Marginal compressed size of strings, with identifiers and what stands around them
    as dictionary. Pieces are short and follow a text that the dictionary holds, so
    that their literals are stored, not coded: the size counts what is in neither."""

    LEAD = " client_secret config_header user-token "
    PIECE = 48

    def __init__(self, settings: Settings):
        self.settings = settings
        self.primed = (COMMON + IDENTIFIERS + self.LEAD).encode()

    def of(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes that the candidate adds to its surroundings, per byte."""
        known = zstandard.ZstdCompressionDict(self.primed + (before + " " + after).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        zstd = zstandard.ZstdCompressor(self.settings.level, dict_data=known, write_content_size=False, write_checksum=False)
        data, lead = candidate.encode(), self.LEAD.encode()
        bare = len(zstd.compress(lead))
        return sum(len(zstd.compress(lead + data[k : k + self.PIECE])) - bare for k in range(0, len(data), self.PIECE)) / len(data)

    def found(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        out = []
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            if b - a < LONG_WORD and WORD.fullmatch(m[0]):
                continue
            if not SENSITIVE.search(text, max(0, a - REACH), a) and not SENSITIVE.search(text, b, b + REACH):
                continue
            if any(x < b and a < y for x, y, _ in taken):
                continue
            if self.of(text[max(0, a - AROUND) : a], m[0], text[b : b + AROUND]) >= self.settings.novelty:
                out.append((a, b, "novel"))
        return out


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, spans) of every whole text; spans are an array of struct(kind,
    start, end) in code points, end exclusive, by start and then by kind.

    A null or empty text has no spans; repeated rows stay repeated; other columns
    are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty(settings)
        for batch in batches:
            spans = []
            for text in batch["text"]:
                base = known(text)
                every = base + novelty.found(text, base)
                every.sort(key=lambda x: (x[0], KINDS.index(x[2])))
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in every])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    source = texts(docs)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts of the known shapes, a digest of their spans, and all spans as text."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(each, ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return scan(docs, settings).select(
        "doc_id", *(count(k) for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count("novel"),
    )
