"""Line dedup with DataFrame operations only: equal lines, and lines a few edits apart.

Every line that has an equal line before it, in the order of document id and line
number, is removed, and every line of at least ``least`` characters that has a near
one of as many before it. Empty lines stay, unless ``shortest`` is 0.

Equal lines meet in one aggregate. Near ones meet in patterns: a text with stars,
each of which stands for one character or none. Two lines are at most k edits apart
if and only if both fit one pattern of k stars, so all lines of a pattern are near
each other, and each is set against the earliest. Patterns are narrowed down, and
no step loses a pair: k edits leave one of k + 1 pieces intact, up to a shift, and
only lines that share a piece go on. Where few share one, each is set against the
earlier of them at once. For the others the stars are known by windows that hold them, a line is hashed outside its windows, and windows on which a line agrees with
an earlier one are cut again, down to single places. Bounds of 1 to k are searched
in turn, and what a smaller bound removes asks no more for a witness. The pair is
verified by its edit distance.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged


# The patterns of a line grow with the length to this power.
MOST_EDITS = 3
# Characters at either end that are compared before whole lines.
ENDS = 64
# Arrays that the windows of a line are dealt to.
PARTS = 8


@dataclass(frozen=True)
class Settings:
    least: int = 10  # characters of a line that near lines are looked for
    shortest: int | None = None  # characters of a line that equal lines are looked for; None: ``least``
    edits: int = 1  # 0: equal lines alone; up to MOST_EDITS
    block: int = 64  # a search for k edits cuts each window into the (k + 1)th root of this
    bucket: int = 200  # lines that share a piece, up to which each is set against the earlier ones; more meet in patterns
    bucket_characters: int = 1 << 20  # and characters that these lines may have together
    broadcast: int = 500_000  # rows of ids that may be broadcast; more are joined by shuffle

    def __post_init__(self):
        if self.edits not in range(MOST_EDITS + 1):
            raise ValueError(f"edits must be 0 to {MOST_EDITS}, not {self.edits!r}")
        if self.equal_from > self.least:
            raise ValueError(f"shortest must be {self.least} at most, not {self.shortest!r}")

    @property
    def equal_from(self) -> int:
        return self.least if self.shortest is None else self.shortest


# What the registered query and the pipeline take.
CORPUS = Settings(edits=2, shortest=1)


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, version, at, line): the lines of so many characters at least; ``version`` tells texts of one id apart."""
    every = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return every.filter(F.length("line") >= least)


def line_id() -> list[Column]:
    """Two hashes that together name a line."""
    return [F.xxhash64("line").alias("a"), F.xxhash64(F.lit("b"), "line").alias("b")]


def piece_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` without their text ``line``, one row per ``key`` of their pieces, of which
    near lines have one in common.

    A pattern is as long as the line and its stars that stand for no character
    (``none``); it is cut into edits + 1 pieces. Before a piece there are
    ``before`` of those stars, all of them before the last piece. Pieces are rows
    before they are cut: one short expression for all of them is compiled, an array
    of their expressions is not.
    """
    pieces = []
    for none in range(edits + 1):
        for q in range(edits + 1):
            for before in [0] if q == 0 else [none] if q == edits else range(none + 1):
                pieces.append(F.struct(F.lit(none).alias("none"), F.lit(q).alias("q"), F.lit(before).alias("before")))
    rest = [c for c in lines.columns if c != "line"]
    each = lines.select(*rest, "line", F.length("line").alias("__n"), F.explode(F.array(*pieces)).alias("__p"))
    size, q = F.col("__n") + F.col("__p.none"), F.col("__p.q")
    long = F.ceil(size / (edits + 1)).cast("int")
    piece = F.substring("line", q * long + (1 - F.col("__p.before")), F.greatest(F.least(long, size - q * long), F.lit(0)))
    return each.select(*rest, F.xxhash64(size, q, piece).alias("key"))


def narrowed(state: DataFrame, text: DataFrame, stars: int, pieces: int) -> DataFrame:
    """Every window of ``state`` cut into ``pieces``: (a, b, size, wide, stars, key, place, open).

    ``state`` has a few rows per line, each with an array of ``windows``, so that the
    text of a line meets its windows once. ``size`` is the length of the pattern,
    ``stars`` an array of struct(lo, none): where the window of each begins, and 1
    for a star without a character. ``key`` is the line outside the windows, at the
    places they leave.
    """
    # few rows come in and many go out: dealt to all tasks, however small they are
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = state.join(text, ["a", "b"]).repartition(tasks, "a", "b", "part")
    rows = rows.select("a", "b", "line", "place", "open", F.inline("windows")).withColumn("step", F.ceil(F.col("wide") / pieces).cast("int"))
    size, step = F.col("size"), F.col("step")
    cut = F.array(F.array().cast("array<struct<lo: int, none: int>>"))

    def with_star(k: int):
        star = F.get("stars", F.lit(k))
        places = F.sequence(star["lo"], F.least(star["lo"] + F.col("wide"), size) - 1, step)

        def add(done: Column) -> Column:
            last = F.get(done, F.lit(k - 1))["lo"]
            # in order; two stars are never in one place
            free = F.filter(places, lambda lo: (lo > last) | ((lo == last) & (step > 1))) if k else places
            return F.transform(free, lambda lo: F.concat(done, F.array(F.struct(lo.alias("lo"), star["none"].alias("none")))))

        return add

    for k in range(stars):
        cut = F.flatten(F.transform(cut, with_star(k)))
    rows = rows.withColumn("cut", F.explode(cut)).drop("stars", "wide").withColumnsRenamed({"cut": "stars", "step": "wide"})

    outside, begin, none = [], F.lit(0), F.lit(0)
    for k in range(stars + 1):
        end = F.get("stars", F.lit(k))["lo"] if k < stars else size
        outside.append(F.substring("line", begin - none + 1, F.greatest(end - begin, F.lit(0))))
        if k < stars:
            begin, none = F.least(end + F.col("wide"), size), none + F.get("stars", F.lit(k))["none"]
    los = [F.get("stars", F.lit(k))["lo"] for k in range(stars)]
    return rows.select("a", "b", "size", "wide", "stars", F.xxhash64("size", *los, *outside).alias("key"), "place", "open")


def by_line(windows: DataFrame) -> DataFrame:
    """(a, b, part, windows): the windows of each line, in ``PARTS`` arrays at most."""
    part = F.pmod(F.xxhash64("size", "stars"), F.lit(PARTS)).alias("part")
    return windows.groupBy("a", "b", part).agg(F.collect_list(F.struct("size", "wide", "stars")).alias("windows"))


def witnessed(text: DataFrame, stars: int, s: Settings) -> DataFrame:
    """(a, b) of the open lines of ``text`` (a, b, line, place, open) that have an
    earlier line at exactly so many edits."""
    pieces = max(2, round(s.block ** (1 / (stars + 1))))
    roles = [F.array(*(F.struct(F.lit(0).alias("lo"), F.lit(x).alias("none")) for x in e)) for e in product((0, 1), repeat=stars)]
    state = text.select("a", "b", "line", F.explode(F.array(*roles)).alias("stars"))
    size = F.length("line") + F.aggregate("stars", F.lit(0), lambda n, x: n + x["none"])
    state = by_line(state.select("a", "b", size.alias("size"), size.alias("wide"), "stars"))
    wide = (text.agg(F.max(F.length("line"))).first()[0] or 0) + stars
    row = F.struct("place", "a", "b")
    while True:
        wide = -(-wide // pieces)
        rows = narrowed(state, text, stars, pieces)
        groups = rows.groupBy("key").agg(F.min(row).alias("w"), F.max(F.when(F.col("open"), F.col("place"))).alias("last"))
        # some open line of the group has an earlier one
        alive = small(staged(groups.filter("last > w.place").select("key", "w"), "alive"), s.broadcast)
        if wide <= 1:
            break
        state = staged(by_line(rows.join(alive, "key", "left_semi")), "windows")
    pairs = rows.filter("open").join(alive, "key").filter("w.place < place")
    pairs = pairs.select("a", "b", F.col("w.a").alias("wa"), F.col("w.b").alias("wb")).distinct()
    witness = text.select(F.col("a").alias("wa"), F.col("b").alias("wb"), F.col("line").alias("earlier"))
    both = pairs.join(text.select("a", "b", "line"), ["a", "b"]).join(witness, ["wa", "wb"])
    return both.filter(F.levenshtein("line", "earlier", stars).between(0, stars)).select("a", "b").distinct()


def near_pair(x: Column, y: Column, edits: int) -> Column:
    """Whether two lines are near. The time of an edit distance grows with the square of
    the length, so their ends come first: where lines are near, both begin, and both end,
    with texts of one length at twice the edits."""
    begin, end = (F.levenshtein(F.substring(x, p, ENDS), F.substring(y, p, ENDS), 2 * edits) >= 0 for p in (1, -ENDS))
    return begin & end & (F.levenshtein(x, y, edits) >= 0)


def near_in_small_buckets(keyed: DataFrame, text: DataFrame, s: Settings) -> DataFrame:
    """(a, b) of lines that have an earlier line within the edits among the few that share
    a piece with them. ``keyed`` has the different keys (key, a, b) of such buckets; each is
    an array of ``s.bucket`` lines at most, judged in its row. Two lines that meet in
    several buckets are judged in that of their least common key."""
    keys = keyed.groupBy("a", "b").agg(F.collect_list("key").alias("keys"))
    members = keys.join(text.select("a", "b", "line", "place"), ["a", "b"])
    members = members.select(F.explode("keys").alias("key"), F.struct("place", "a", "b", "line", "keys").alias("x"))
    buckets = members.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("m"))

    def near(x: Column, i: Column) -> Column:
        earlier = F.slice("m", F.lit(1), i)
        here = lambda y: F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("key")
        return F.exists(earlier, lambda y: here(y) & near_pair(x["line"], y["line"], s.edits))

    found = F.filter("m", lambda x, i: near(x, i))
    return buckets.select(F.explode(F.transform(found, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))).alias("x")).select("x.a", "x.b").distinct()


def near_lines(docs: DataFrame, s: Settings) -> DataFrame:
    """(a, b) of lines that have an earlier line within the edits."""
    lines = lines_of(docs, s.least)
    keys = piece_keys(lines.select(line_id()[0], "line"), s.edits)
    common = keys.groupBy("key").agg(F.min("a").alias("x"), F.max("a").alias("y")).filter("x <> y").select("key")
    common = small(staged(common, "common-pieces"), s.broadcast)
    going_on = small(staged(keys.join(common, "key", "left_semi").select("a").distinct(), "near-ids"), s.broadcast)
    # one row per different line, with its first place
    order = Window.partitionBy("a", "b").orderBy("doc_id", "version", "at")
    text = lines.select("doc_id", "version", "at", *line_id(), "line").join(going_on, "a")
    text = staged(
        text.withColumn("r", F.row_number().over(order)).filter("r = 1")
        .select("a", "b", "line", F.struct("doc_id", "version", "at").alias("place")),
        "near-lines",
    )
    # buckets of a few lines are judged whole; patterns are for the lines of the others
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = text.repartition(tasks, "a").select("a", "b", F.length("line").alias("size"), "line")
    keyed = staged(piece_keys(sizes, s.edits).dropDuplicates(["a", "b", "key"]), "piece-keys")
    sized = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("characters")).filter("n > 1")
    few = ((F.col("n") <= s.bucket) & (F.col("characters") <= s.bucket_characters)).alias("few")
    keyed = staged(keyed.drop("size").join(sized.select("key", few), "key"), "bucket-keys")
    near = staged(near_in_small_buckets(keyed.filter("few").drop("few"), text, s), "near-0")
    many = staged(keyed.filter("not few").select("a", "b").distinct(), "crowded")
    text = staged(text.join(many, ["a", "b"], "left_semi"), "crowded-lines")
    if text.isEmpty():
        return near
    for stars in range(1, s.edits + 1):
        known = near.withColumn("known", F.lit(True))
        state = text.join(known, ["a", "b"], "left").select("a", "b", "line", "place", F.col("known").isNull().alias("open"))
        near = staged(near.unionByName(witnessed(state, stars, s)), f"near-{stars}")
    return near


def removed_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, version, removed): for documents that lose lines, their numbers from 0."""
    lines = staged(lines_of(docs, s.equal_from).select("doc_id", "version", "at", *line_id()), "lines")
    firsts = lines.groupBy("a", "b").agg(F.min(F.struct("doc_id", "version", "at")).alias("first"), F.count("*").alias("n"))
    if s.edits:
        near = near_lines(docs, s).withColumn("near", F.lit(True))
        firsts = firsts.join(near, ["a", "b"], "left")
    else:
        firsts = firsts.withColumn("near", F.lit(None).cast("boolean"))
    gone = lines.select("doc_id", "version", "at", "a", "b").join(firsts.filter("n > 1 or near"), ["a", "b"])
    gone = gone.filter(F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "version", "at") != F.col("first")))
    return gone.groupBy("doc_id", "version").agg(F.collect_set("at").alias("removed"))


def dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``; all columns stay, and two
    are added last: ``__lines``, the lines there were, and ``__removed``, how many went.

    A null text stays null, without lines; an empty one is an empty line. Rows of one id follow each other by a hash of their text; rows
    that repeat id and text are one document and lose the same lines. Lines without
    an id come first. An empty table stays empty.
    """
    gone = staged(removed_lines(docs, s), "removed-lines").select(
        F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("removed").alias("__gone")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__version"))
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("__gone", F.array().cast("array<int>")))
    every = F.get(F.transform(F.array(lines), lambda x: F.transform(kept, lambda i: F.get(x, i))), F.lit(0))
    return (
        docs.join(small(gone, s.broadcast), same, "left")
        .withColumns({
            "__lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            "__removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
            "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(every, "\n")),
        })
        .drop("__id", "__version", "__gone")
    )


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every document; a null text counts as empty."""
    kept = dedup(docs.select("doc_id", "text"), s)
    return kept.select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
