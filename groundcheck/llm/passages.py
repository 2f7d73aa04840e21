"""Passages that repeat across review notes: paragraph MinHash banding, exact checks and components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from groundcheck.lineage import cut_lineage, discard, release
from groundcheck.llm.bitmaps import bitmap
from groundcheck.llm.common import components, map_text, slices, small_batches
from groundcheck.llm.ngram_join import SHORT, hot_links, shingle_hashes, verified, word_hashes
from groundcheck.llm.words import word_bytes

#: Kinds of units: a whole paragraph (line) and a piece of one, cut where its words say so.
PARAGRAPH, PIECE = 0, 1
#: Words on either side that decide where a piece ends (the chunk of :func:`piece_ends` is the most).
REACH = 12
#: Bytes that belong to words: all but ASCII white space.
_WORD = word_bytes((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` minima that let a pair of the given similarity collide with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def periodic_runs(words: np.ndarray, ends: np.ndarray, longest: int = 4, least: int = 12) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of the runs of ``least`` words or more in a line that repeat up to ``longest`` words."""
    starts = np.concatenate([[0], ends[:-1]])
    line = np.repeat(np.arange(len(ends)), ends - starts)
    held, found = np.zeros(len(words), bool), []
    for q in range(1, longest + 1):
        same = (words[:-q] == words[q:]) & (line[:-q] == line[q:])
        flips = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        long = flips[1::2] - flips[::2] + q >= least
        for a, b in zip(flips[::2][long], flips[1::2][long] + q):
            free = np.flatnonzero(~held[a:b])
            if len(free) and free[-1] - free[0] + 1 >= least and not held[a + free[0]:a + free[-1] + 1].any():
                a, b = a + int(free[0]), a + int(free[-1]) + 1
                held[a:b] = True
                found.append((int(a), int(b), q))
    return found


def piece_ends(words: np.ndarray, ends: np.ndarray, radius: int = 4, chunk: int = 12) -> np.ndarray:
    """Ends of the pieces of all lines (which end at ``ends``): after each pair of words whose hash is the strict
    minimum of its surroundings in the line.

    Equal runs of words are cut alike, whatever stands around them (but for ``radius`` words at their ends).
    Words that repeat at once, up to ``radius`` in turn, have no strict minimum: they are cut at both ends and,
    from the first place where their least rotation begins, every ``chunk`` words (a multiple of all periods).
    """
    pair = _mix((words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ words[1:])
    if len(pair) <= 2 * radius:
        return ends
    middle = np.arange(radius, len(pair) - radius)
    line = np.searchsorted(ends, middle, side="right")
    starts = np.concatenate([[0], ends[:-1]])
    inside = (middle - radius >= starts[line]) & (middle + radius <= ends[line] - 2)
    least, centre = np.ones(len(middle), bool), pair[radius:len(pair) - radius]
    for j in range(2 * radius + 1):
        if j != radius:
            least &= centre < pair[j:j + len(middle)]
    cuts, more = middle[inside & least] + 2, [ends]
    runs = periodic_runs(words, ends, radius)
    if runs:
        within = np.zeros(len(words) + 1, bool)
        for a, b, q in runs:
            within[a + 1:b] = True
            turn = min(range(q), key=lambda r: words[a + r:a + r + q].tolist())
            more += [[a], np.arange(a + turn, b, chunk), [b]]
        cuts = cuts[~within[cuts]]
    found = np.union1d(cuts, np.concatenate(more)).astype(np.int64)
    return found[found > 0]


def digests(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash of the words of every unit, in their order."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    place = (np.arange(len(words)) - np.repeat(starts, sizes) + 1).astype(np.uint64)
    mixed = _mix(words + place * np.uint64(0x9E3779B97F4A7C15))
    return _mix(np.add.reduceat(mixed, starts) + sizes.astype(np.uint64))


def _lines(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Word hashes of all texts, the end of every line with words, the text it is of, and the line."""
    from xxhash import xxh3_64_intdigest

    words, sizes, places, lines = [], [], [], []
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            own = line.encode().lower().split()
            if own:
                words += own
                sizes.append(len(own))
                places.append(i)
                lines.append(line)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    return hashes, np.cumsum(np.array(sizes, np.int64)), np.array(places, np.int64), lines


def _unit_rows(least_words: int, width: int, rows: int, bands: int, seed: int = 5):
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketches(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Per line and band a hash of its minima over the line's shingles."""
        grams = shingle_hashes(words, width)
        # from a line's first shingle up to its last, then over those that reach into the next line
        cuts = np.stack([starts, ends - width + 1], axis=1).ravel()
        cuts = cuts[:-1] if cuts[-1] >= len(grams) else cuts
        least = np.empty((len(starts), rows * bands), np.uint64)
        for j, f in enumerate(factors):
            x = grams * f
            least[:, j] = np.minimum.reduceat(x ^ (x >> np.uint64(31)), cuts)[::2]
        out = np.empty((len(starts), bands), np.uint64)
        for b in range(bands):
            x = np.full(len(starts), b + 1, np.uint64)
            for j in range(b * rows, (b + 1) * rows):
                x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + least[:, j])
            out[:, b] = x
        return out

    def make():
        def run(texts):
            words, ends, places, _ = _lines(texts)
            kinds = pa.list_(pa.int64())
            if not len(words):
                return [[], [], [], [], [], pa.array([], kinds)], []
            starts = np.concatenate([[0], ends[:-1]])
            first_line = np.searchsorted(places, places, side="left")  # of the same text
            origin = starts[first_line]
            long = np.flatnonzero(ends - starts >= max(least_words, width))
            lines = digests(words, ends)[long]
            sketch = sketches(words, starts[long], ends[long]) if len(long) else np.zeros((0, bands), np.uint64)
            pieces = piece_ends(words, ends)
            from_ = np.concatenate([[0], pieces[:-1]])
            line = np.searchsorted(ends, from_, side="right")
            hashes = np.concatenate([lines, digests(words, pieces)]).view(np.int64)
            firsts = np.concatenate([(starts - origin)[long], from_ - origin[line]]).astype(np.int32)
            of_line = np.concatenate([(starts - origin)[long], (starts - origin)[line]]).astype(np.int32)
            sizes = np.concatenate([(ends - starts)[long], pieces - from_]).astype(np.int32)
            which = np.concatenate([np.full(len(long), PARAGRAPH), np.full(len(pieces), PIECE)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(long) + 1) * bands, pa.int32()),
                                             pa.array(sketch.view(np.int64).ravel()))
            return [which, hashes, firsts, of_line, sizes, pa.concat_arrays([lists, pa.nulls(len(pieces), kinds)])], \
                np.concatenate([places[long], places[line]])
        return run
    return make


def _line_sets(width: int):
    """Size and bitmap of the set of a line's shingles."""
    def make():
        def run(lines):
            sets = [np.unique(shingle_hashes(word_hashes(t), width)) for t in lines]
            return [[len(x) for x in sets], [bitmap(x) for x in sets]], None
        return run
    return make


def _line_texts():
    def make():
        def run(texts):
            words, ends, places, lines = _lines(texts)
            found = digests(words, ends).view(np.int64) if len(words) else np.zeros(0, np.int64)
            return [found, lines], places
        return run
    return make


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of every entry of a list column, and the entries."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _numbers(entries: pa.Array, name: str) -> np.ndarray:
    return pc.struct_field(entries, name).to_numpy(zero_copy_only=False).astype(np.int64)


def _laid(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, starts and ends of their lines, and the place of every text's first word."""
    words, ends, places, _ = _lines(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    base = np.concatenate([starts, [len(words)]])[np.searchsorted(places, np.arange(len(texts)))]
    return words, starts, ends, base


def _picked(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> pa.Array:
    """Lists of ``sizes`` words each: from ``at`` on forwards (``step`` 1) or backwards (-1)."""
    stops = np.cumsum(sizes)
    inside = np.arange(int(sizes.sum())) - np.repeat(stops - sizes, sizes)
    values = words[np.repeat(at, sizes) + inside * np.repeat(step, sizes)].view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(values, pa.int64()))


def _asked(batches):
    """Per run of repeated pieces and side: the first place it continues at, and the words that stand there here.

    A whole piece and the words that decide its ends would be a repeated piece themselves, so no match
    reaches farther than that.
    """
    for batch in slices(batches):
        row, units = _flat(batch.column("units"))
        words, starts, ends, base = _laid(batch.column("t").to_pylist())
        pieces = piece_ends(words, ends)
        best = pc.struct_field(units, "best")
        size, first = _numbers(units, "size"), _numbers(best, "first")
        a = base[row] + _numbers(units, "first")
        b = a + size
        line = np.searchsorted(ends, a, side="right")
        start, end = starts[line], ends[line]
        # where no other repeated piece stands beside
        before = np.flatnonzero((a > start) & ~np.isin(a, b))
        behind = np.flatnonzero((b < end) & ~np.isin(b, a))
        far = np.searchsorted(pieces, a[before]) - 1
        low = np.maximum(start[before], np.where(far > 0, pieces[np.maximum(far - 1, 0)], 0) - 2 * REACH)
        high = np.minimum(end[behind], pieces[np.searchsorted(pieces, b[behind], side="right")] + 2 * REACH)
        unit = np.concatenate([before, behind])
        side = np.repeat([0, 1], [len(before), len(behind)])
        told = _picked(words, np.concatenate([a[before] - 1, b[behind]]),
                       np.concatenate([a[before] - low, high - b[behind]]), 2 * side - 1)
        at, held = np.concatenate([a[before], b[behind]]) - base[row[unit]], pa.array(unit)
        yield pa.RecordBatch.from_arrays(
            [batch.column("k").take(pa.array(row[unit])), batch.column("u").take(pa.array(row[unit])),
             pa.array(side, pa.int32()), pa.array(at, pa.int32()), pc.struct_field(best, "k").take(held),
             pc.struct_field(best, "u").take(held), pa.array(first[unit] + side * size[unit], pa.int32()), told],
            names=["k", "u", "side", "at", "bk", "bu", "bat", "words"])


def _told(batches):
    """The words at the asked places of every note: those before them, the nearest first, or those behind."""
    for batch in slices(batches):
        row, asks = _flat(batch.column("asks"))
        words, starts, ends, base = _laid(batch.column("t").to_pylist())
        side, at, n = (_numbers(asks, c) for c in ("side", "bat", "n"))
        p = base[row] + at
        line = np.searchsorted(ends, p - side, side="right")
        sizes = np.where(side == 1, np.minimum(ends[line], p + n) - p, p - np.maximum(starts[line], p - n))
        told = _picked(words, p - (side == 0), sizes, 2 * side - 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("k").take(pa.array(row)), batch.column("u").take(pa.array(row)), pa.array(side, pa.int32()),
             pa.array(at, pa.int32()), told], names=["tk", "tu", "side", "bat", "told"])


def _stretched(notes: DataFrame, repeated: DataFrame) -> DataFrame:
    """Words beside the runs of repeated pieces that the first place has too: ``k, u, first, size``."""
    def on(key: str, text: str):
        return F.col("k").eqNullSafe(F.col(key)) & (F.col("u") == F.col(text))

    kind = notes.schema["k"].dataType.simpleString()
    runs = repeated.filter(F.col("kind") == PIECE).groupBy(F.col("k").alias("mk"), F.col("u").alias("mu")).agg(
        F.collect_set(F.struct("first", "size", "best")).alias("units"))
    # rows that repeat a key and text tell the same; what they add twice is one unit in the end
    with small_batches(notes.sparkSession):
        asks = cut_lineage(notes.join(runs, on("mk", "mu")).select("k", "u", "t", "units").mapInArrow(
            _asked, f"k {kind}, u bigint, side int, at int, bk {kind}, bu bigint, bat int, words array<bigint>"))
    release(notes.sparkSession)
    places = asks.groupBy("bk", "bu", "side", "bat").agg(F.max(F.size("words")).alias("n")).groupBy("bk", "bu").agg(
        F.collect_list(F.struct("side", "bat", "n")).alias("asks"))
    told = notes.join(places, on("bk", "bu")).select("k", "u", "t", "asks").mapInArrow(
        _told, f"tk {kind}, tu bigint, side int, bat int, told array<bigint>")
    both = asks.join(told, F.col("bk").eqNullSafe(F.col("tk")) & (F.col("bu") == F.col("tu"))
                     & (asks["side"] == told["side"]) & (asks["bat"] == told["bat"]))
    differ = F.array_position(F.zip_with("words", "told", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    size = F.when(differ > 0, differ - 1).otherwise(F.size("words")).cast("int")
    return both.select("k", "u", asks["side"].alias("side"), "at", size.alias("size")).filter("size > 0").select(
        "k", "u", F.when(F.col("side") == 0, F.col("at") - F.col("size")).otherwise(F.col("at")).alias("first"), "size")


def _without(texts: pa.Array, units: pa.Array, least_words: int) -> tuple[pa.Array, np.ndarray]:
    """The texts without the words of their units, and how many those are; what stands before the first word stays."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    begins = _WORD[data]
    begins[1:] &= ~begins[:-1]
    opens = offsets[:-1][offsets[:-1] < len(data)]
    begins[opens] = _WORD[data[opens]]
    words = np.flatnonzero(begins)
    # slots: for every text what stands before its first word, then its words, each with the white space behind it
    lead = np.searchsorted(words, offsets[:-1]) + np.arange(len(texts))
    slots = np.zeros(len(words) + len(texts), np.int64)
    slots[lead] = offsets[:-1]
    slots[np.delete(np.arange(len(slots)), lead)] = words
    sizes = np.diff(np.concatenate([slots, [len(data)]]))

    def covered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        turns = np.bincount(a, minlength=len(slots) + 1) - np.bincount(b, minlength=len(slots) + 1)
        return np.cumsum(turns) > 0

    row, units = _flat(units)
    a = lead[row] + 1 + _numbers(units, "first")
    b = a + _numbers(units, "size")
    whole = _numbers(units, "kind") == PARAGRAPH
    held = np.concatenate([[False], covered(a[~whole], b[~whole])]).astype(np.int8)
    flips = np.flatnonzero(np.diff(held))
    runs = flips[::2], flips[1::2]
    long = runs[1] - runs[0] >= least_words  # a few common words in a row are no passage
    gone = (covered(a[whole], b[whole]) | covered(runs[0][long], runs[1][long]))[:-1]
    kept = np.add.reduceat(np.where(gone, 0, sizes), lead)
    cut = data[np.repeat(~gone, sizes)]
    out = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)), pa.py_buffer(cut))
    return out.cast(pa.string()), np.add.reduceat(gone.astype(np.int64), lead)


def _cut(least_words: int):
    def make_rows(batches):
        for batch in slices(batches):
            texts, units = batch.column("t").cast(pa.string()), batch.column("units")
            removed = np.zeros(batch.num_rows, np.int64)
            marked = np.flatnonzero(pc.fill_null(pc.list_value_length(units), 0).to_numpy(zero_copy_only=False))
            if len(marked):
                at = pa.array(marked)
                cut, removed[marked] = _without(texts.take(at), units.take(at), least_words)
                mask = np.zeros(batch.num_rows, bool)
                mask[marked] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), cut)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 2)), texts, pa.array(removed)],
                names=[*batch.schema.names[:-2], "t", "removed"])
    return make_rows


def drop_repeated_passages(events: DataFrame, key: str = "event_id", text: str = "notes", least_words: int = 16,
                           width: int = 5, percent: int = 80, rows: int = 3, recall: float = 0.99) -> DataFrame:
    """Remove from every note the passages that an earlier note (or an earlier place of it) has.

    Units are paragraphs (lines) of ``least_words`` words or more, and pieces of lines, cut where their own words say so,
    for passages inside longer paragraphs.  Paragraphs are equal or near-equal: MinHash bands (their
    number is tuned to ``recall`` at the similarity) give collisions, which are checked by the exact
    Jaccard similarity of the paragraphs' ``width``-word shingles and clustered by components.  Pieces
    count as repeated where they are equal.  Of each class the first place (smallest key, then place)
    stays, of a piece the first one outside the paragraphs that go; other paragraphs go, and runs of repeated pieces of ``least_words`` or more.  A run also takes
    the words beside it in the line as far as they are those beside its piece's first place; of words
    repeated in turn, less than one turn may stay at the beginning.

    Within a band's bucket every paragraph is first compared with the smallest and the largest; where
    that leaves several components, the pairs across them are compared too, those of large buckets in blocks, so a
    large bucket of near copies needs no pair of all.  Bitmaps of the shingles rule most pairs out before a text is
    read.  Paragraphs are told apart by 64-bit hashes of their words.

    Returns all columns of ``events`` (the text cut) and ``words_removed``.  Words compare with A-Z
    lower-cased.  A null text stays null, an empty one empty; a note that is all repeated is left empty;
    rows that repeat a key and text count as one note; rows without a key come last; an empty table gives no rows.
    """
    if "words_removed" in events.columns:
        raise ValueError("a column may not be called words_removed")
    names = events.columns
    rest = [c for c in names if c != text]
    rows_ = events.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)), F.col(key).alias("k"),
                          F.xxhash64(F.col(text)).alias("u"), F.col(text).cast("string").alias("t"))
    bands = bands_for(percent / 100, rows, recall)
    notes = rows_.select("k", "u", "t")
    with small_batches(events.sparkSession):
        units = cut_lineage(map_text(notes, "t", _unit_rows(least_words, width, rows, bands),
                         "kind int, h bigint, first int, line int, size int, sketch array<bigint>"))
    # pieces are many and most stand in one place only: those are dropped by bare hashes, before anything is sorted
    pieces = units.filter(F.col("kind") == PIECE).drop("sketch")
    often = pieces.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    pieces = cut_lineage(pieces.join(often, "h", "left_semi"))
    paragraphs = cut_lineage(units.filter(F.col("kind") == PARAGRAPH))
    discard(units)
    release(events.sparkSession)
    place = F.struct(F.col("k").isNull().alias("z"), "k", "u", "first")
    # near-equal paragraphs
    lines = cut_lineage(paragraphs.groupBy("h").agg(
        F.count("*").alias("c"), F.min(place).alias("one"), F.min("sketch").alias("sketch")))
    buckets = lines.select("h", F.explode("sketch").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi")
    met = cut_lineage(buckets.join(crowded, "bucket"))
    stars = cut_lineage(met.filter("h <> lo").select(F.col("lo").alias("a"), F.col("h").alias("b")).unionByName(
        met.filter("h <> hi").select(F.col("h").alias("a"), F.col("hi").alias("b"))).distinct())
    wanted = met.select("h").distinct().join(lines.select("h", "one"), "h").select("h", "one.k", "one.u")
    texts = notes.join(wanted.select("k", "u").distinct().withColumnRenamed("k", "wk").withColumnRenamed("u", "wu"),
                       F.col("k").eqNullSafe(F.col("wk")) & (F.col("u") == F.col("wu"))).select("t")
    texts = cut_lineage(map_text(texts, "t", _line_texts(), "h bigint, line string").groupBy("h").agg(
        F.min("line").alias("t")).join(wanted.select("h"), "h", "left_semi").withColumnRenamed("h", "id"))
    sets = cut_lineage(map_text(texts.withColumnRenamed("t", "line"), "line", _line_sets(width), "n int, bits binary"))
    release(events.sparkSession)

    found = components(verified(stars, sets, texts, width, percent), "a", "b").withColumnRenamed("node", "h")
    placed = met.select("bucket", "h").join(found, "h", "left").select(
        "bucket", "h", F.coalesce("component", "h").alias("c"))
    open_ = placed.groupBy("bucket").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("members")).filter("lo <> hi")
    left = cut_lineage(placed.join(open_.select("bucket", "members"), "bucket"))
    # small buckets pair by pair, large ones in blocks
    few = left.filter(F.col("members") <= SHORT)
    more = few.select("bucket", F.col("h").alias("a"), F.col("c").alias("ca")).join(
        few.select("bucket", F.col("h").alias("b"), F.col("c").alias("cb")), "bucket").filter(
        "a < b and ca <> cb").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    more = cut_lineage(more)
    links = verified(more, sets, texts, width, percent)
    many = left.filter(F.col("members") > SHORT).select(F.col("bucket").alias("gram"), F.col("h").alias("id"), "c")
    if many.limit(1).count():
        links = links.unionByName(hot_links(many, texts, width, percent))
    found = components(found.select(F.col("h").alias("a"), F.col("component").alias("b")).unionByName(links), "a", "b"
                       ).withColumnRenamed("node", "h")
    discard(met, stars, texts, sets, left, more)
    release(events.sparkSession)

    # the first place of every class, over all near-equal paragraphs
    grouped = lines.join(found, "h", "left").select("h", "one", "c", F.coalesce("component", "h").alias("group"))
    best = grouped.groupBy("group").agg(F.min("one").alias("best"), F.sum("c").alias("n")).filter("n > 1")
    firsts = grouped.join(best, "group").select("h", "best")
    whole = cut_lineage(paragraphs.drop("sketch").join(firsts, "h").filter(
        place != F.col("best")).select("k", "u", "kind", "first", "size", "best"))
    # and of every piece, over the paragraphs that stay
    gone = whole.select(F.col("k").alias("gk"), F.col("u").alias("gu"), F.col("first").alias("gone")).distinct()
    parts = cut_lineage(pieces.join(
        gone, F.col("k").eqNullSafe(F.col("gk")) & (F.col("u") == F.col("gu")) & (F.col("line") == F.col("gone")),
        "left_anti"))
    twice = parts.groupBy("h").agg(F.count("*").alias("c"), F.min(place).alias("best")).filter("c > 1").drop("c")
    repeated = cut_lineage(parts.join(twice, "h").filter(place != F.col("best")).select(
        "k", "u", "kind", "first", "size", "best").unionByName(whole))
    discard(paragraphs, pieces, parts, whole, lines)
    release(events.sparkSession)
    beside = _stretched(notes, repeated).withColumn("kind", F.lit(PIECE))
    marks = repeated.drop("best").unionByName(beside).groupBy(F.col("k").alias("mk"), F.col("u").alias("mu")).agg(
        F.collect_set(F.struct("kind", "first", "size")).alias("units"))
    marked = rows_.join(marks, F.col("k").eqNullSafe(F.col("mk")) & (F.col("u") == F.col("mu")), "left")
    kept = [f"c{i}" for i in range(len(rest))]
    fields = ", ".join([*(f"c{i} {events.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)),
                        "t string", "removed bigint"])
    cut = marked.select(*kept, "t", "units").mapInArrow(_cut(least_words), fields)
    back = {c: F.col(f"c{i}") for i, c in enumerate(rest)} | {text: F.col("t")}
    return cut.select(*(back[c].alias(c) for c in names), F.col("removed").alias("words_removed"))
