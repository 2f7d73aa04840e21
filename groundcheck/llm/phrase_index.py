"""Review notes that repeat given texts: a distributed positional inverted index and phrase search in it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from groundcheck.lineage import cut_lineage, discard
from groundcheck.llm.words import byte_slices, find_words, word_bytes

#: Bytes of text in one segment of the index.
SEGMENT = 2 << 20
#: Places left free between two notes of a segment, so that no match runs over both.
GAP = 1024
#: Windows that are searched for at once (one broadcast); more are searched in blocks.
WINDOWS = 100_000
#: Candidates that are tested at once inside a segment.
TESTED = 1 << 20

#: Words: digits, letters and everything outside ASCII.
WORD = word_bytes((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the high bit set on all but a value's last byte; and the first byte of each."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = ((values[has] >> (7 * k)) & 127) | ((size[has] > k + 1).astype(np.int64) << 7)
    return out, at


def decode(data: np.ndarray) -> np.ndarray:
    """The values that :func:`encode` wrote."""
    if not len(data):
        return np.zeros(0, np.int64)
    last = data < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    within = np.arange(len(data)) - starts[np.cumsum(last) - last]
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * within), starts)


@dataclass
class PhraseIndex:
    """Index of the words of notes.

    ``table`` has a row per segment and term (``term, postings``: places, as coded differences) and one
    per note (``no, key, first, words``: its number and first place in the segment, its word count).
    """

    table: DataFrame


def index_notes(events: DataFrame, key: str = "event_id", text: str = "notes") -> PhraseIndex:
    """Index every word of every note.

    The index is dealt by notes: a task turns at most ``SEGMENT`` bytes of notes (or one longer note) into
    the posting lists of one segment, so the list of a frequent term is spread over all segments and
    building needs no shuffle.  It is written once and can be searched any number of times.

    A null note has no words.  Rows that repeat a key, or have none, are notes of their own.
    """
    rows = events.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    schema = StructType([*StructType.fromDDL("segment long, term long, postings binary, no int").fields,
                         rows.schema["key"], StructField("first", IntegerType()), StructField("words", IntegerType())])

    def build(batches):
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        for batch in byte_slices(batches, 1, SEGMENT):
            found = find_words(batch.column(1), WORD)
            notes = batch.num_rows
            counts = np.bincount(found.text, minlength=notes)
            before = np.cumsum(counts) - counts
            first = before + GAP * np.arange(notes)
            place = np.arange(len(found.hashes)) + GAP * found.text
            terms = found.hashes.view(np.int64)
            order = np.argsort(terms, kind="stable")
            terms, place = terms[order], place[order]
            heads = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            steps = np.diff(place, prepend=0)
            steps[heads] = place[heads]
            data, at = encode(steps)
            ends = np.concatenate([at[heads], [len(data)]]).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            n = len(heads)
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, segment)), pa.array(terms[heads]), lists, pa.nulls(n, pa.int32()),
                 pa.nulls(n, kind), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names=schema.names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(notes, segment)), pa.nulls(notes, pa.int64()), pa.nulls(notes, pa.binary()),
                 pa.array(np.arange(notes), pa.int32()), batch.column(0), pa.array(first, pa.int32()),
                 pa.array(counts, pa.int32())], names=schema.names)
            segment += 1

    return PhraseIndex(cut_lineage(rows.mapInArrow(build, schema)))


def _windows(phrases: DataFrame, phrase_id: str, phrase: str, width: int) -> DataFrame:
    """``id, w, window``: every run of ``width`` words of a phrase, or all its words if it has fewer."""
    rows = phrases.select(F.col(phrase_id).alias("id"), F.coalesce(F.col(phrase).cast("string"), F.lit("")).alias("t"))
    schema = StructType([rows.schema["id"], *StructType.fromDDL("words array<bigint>").fields])

    def split(batches):
        for batch in byte_slices(batches, 1, SEGMENT):
            found = find_words(batch.column(1), WORD)
            ends = np.cumsum(np.bincount(found.text, minlength=batch.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), found.hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=schema.names)

    words = cut_lineage(rows.mapInArrow(split, schema)).filter("size(words) > 0")
    n = F.size("words")
    places = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    runs = words.select("id", "words", F.explode(places).alias("at")).select(
        "id", F.slice("words", F.col("at"), width).alias("w")).distinct()
    return cut_lineage(runs.withColumn("window", F.xxhash64("w")))


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges ``low..high-1`` in a row, and the range of each."""
    size = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[which], which


def _ordered(places: np.ndarray, terms: np.ndarray, width: np.ndarray, counts: np.ndarray, heads: np.ndarray, slop: int):
    """Matches of windows in one segment: window, first and last place.

    ``places`` are ``term << 32 | place`` in order; ``terms`` are the windows' term numbers, -1 beyond their width.
    """
    size = np.where(terms >= 0, counts[terms], 1 << 40)
    live = np.flatnonzero((size > 0).all(axis=1))
    out = []
    while len(live):
        # as many windows at once as their rarest lists allow
        rare = size[live].min(axis=1)
        take = max(int(np.searchsorted(np.cumsum(rare), TESTED, "right")), 1)
        block, live = live[:take], live[take:]
        order = np.argsort(size[block], axis=1, kind="stable")
        step = order[:, 0]
        t = terms[block, step]
        flat, which = _expand(heads[t], heads[t] + counts[t])
        start = (places[flat] & 0xFFFFFFFF) - step[which]
        if slop:
            # the first word of the window, at most ``slop`` places further to the left
            t0 = terms[block, 0][which] << 32
            flat, again = _expand(np.searchsorted(places, t0 + np.maximum(start - slop, 0)),
                                  np.searchsorted(places, t0 + np.maximum(start, -1), "right"))
            pairs = np.unique(np.stack([which[again], places[flat] & 0xFFFFFFFF], 1), axis=0)
            which, start = pairs[:, 0], pairs[:, 1]
            last = start.copy()
            for k in range(1, terms.shape[1]):
                t = terms[block, k][which]
                used = t >= 0
                at = np.minimum(np.searchsorted(places, (t << 32) + last, "right"), len(places) - 1)
                there = (places[at] >> 32 == t) & (places[at] > (t << 32) + last)
                follows = np.where(there, places[at] & 0xFFFFFFFF, 1 << 40)
                last = np.where(used, follows, last)
                keep = last - start <= k + slop
                which, start, last = which[keep], start[keep], last[keep]
            keep = last - start < width[block][which] + slop
            which, start, last = which[keep], start[keep], last[keep]
        else:
            keep = start >= 0
            which, start = which[keep], start[keep]
            for k in range(1, terms.shape[1]):
                # the next rarest list, moved by the word's place in the window
                step = order[:, k][which]
                t = terms[block[which], step]
                wanted = (t << 32) + start + step
                at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
                keep = (t < 0) | (places[at] == wanted)
                which, start = which[keep], start[keep]
            last = start + width[block][which] - 1
        out.append((block[which], start, last))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out))


def _search(table: DataFrame, block: DataFrame, slop: int) -> DataFrame:
    """``segment, no, window, first_word, last_word`` of every match of the block's windows."""
    spark = table.sparkSession
    wanted = block.toArrow()  # at most about WINDOWS rows
    width = np.array([len(w) for w in wanted.column("w").to_pylist()], np.int64)
    names = wanted.column("window").to_numpy()
    flat = wanted.column("w").combine_chunks().flatten().to_numpy()
    terms, at = np.unique(flat, return_inverse=True)
    matrix = np.full((len(width), int(width.max())), -1, np.int64)
    matrix[np.repeat(np.arange(len(width)), width), _expand(np.zeros_like(width), width)[0]] = at
    sent = spark.sparkContext.broadcast((names, width, matrix, terms))

    def segment(rows: list[pa.RecordBatch]):
        names, width, matrix, terms = sent.value
        rows = pa.Table.from_batches(rows).combine_chunks()
        note = rows.filter(rows.column("term").is_null()).sort_by("first")
        lists = rows.filter(rows.column("term").is_valid()).sort_by("term")
        first, no = note.column("first").to_numpy().astype(np.int64), note.column("no").to_numpy()
        blobs = lists.column("postings").combine_chunks().cast(pa.large_binary())
        if not len(blobs):
            return None
        offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset:blobs.offset + len(blobs) + 1]
        data = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        steps, ends = decode(data), np.cumsum(data < 128)
        stops = ends[offsets[1:] - offsets[0] - 1]
        counted = np.diff(stops, prepend=0)
        sums = np.cumsum(steps)
        base = np.concatenate([[0], sums])[stops - counted]
        which = np.searchsorted(terms, lists.column("term").to_numpy())
        places = (np.repeat(which, counted) << 32) + sums - np.repeat(base, counted)
        counts, heads = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        counts[which], heads[which] = counted, stops - counted
        window, start, last = _ordered(places, matrix, width, counts, heads, slop)
        if not len(window):
            return None
        at = np.searchsorted(first, start, "right") - 1
        name = rows.column("segment")[0].as_py()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(window), name)), pa.array(no[at], pa.int32()), pa.array(names[window]),
             pa.array(start - first[at], pa.int32()), pa.array(last - first[at], pa.int32())],
            names=["segment", "no", "window", "first_word", "last_word"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)] if len(ids) else []
            for low, high in zip(cuts, cuts[1:]):
                if held and ids[low] != now:
                    found = segment(held)
                    if found is not None:
                        yield found
                    held = []
                now = ids[low]
                held.append(batch.slice(low, high - low))
        if held:
            found = segment(held)
            if found is not None:
                yield found

    asked = cut_lineage(block.select(F.explode("w").alias("term")).distinct())
    fields = ["segment", "term", "postings", "no", "first"]
    lists = table.filter("term is not null").join(asked, "term", "left_semi").select(*fields)
    together = lists.unionByName(table.filter("term is null").select(*fields))
    return cut_lineage(together.repartition("segment").sortWithinPartitions("segment").mapInArrow(
        run, "segment long, no int, window long, first_word int, last_word int"))


def _found(index: PhraseIndex, phrases: DataFrame, phrase_id: str, phrase: str, width: int, slop: int):
    if not 1 <= width <= width + slop <= GAP:
        raise ValueError(f"width + slop may be 1 to {GAP}")
    windows = _windows(phrases, phrase_id, phrase, width)
    once = windows.select("window", "w").dropDuplicates(["window"])
    blocks = -(-once.count() // WINDOWS)
    spark = windows.sparkSession
    matches = spark.createDataFrame([], "segment long, no int, window long, first_word int, last_word int")
    for b in range(blocks):
        matches = matches.unionByName(_search(index.table, once.filter(F.pmod("window", F.lit(blocks)) == b), slop))
    return windows.select("id", "window", F.size("w").alias("n")), matches


def phrase_matches(index: PhraseIndex, phrases: DataFrame, phrase_id: str = "warning_id", phrase: str = "explanation",
                   width: int = 10, slop: int = 0) -> DataFrame:
    """Where notes hold ``width`` words in a row of a phrase (all its words, if it has fewer).

    ``slop = 0`` finds exact phrases: from the rarest word of a window on, its posting lists are moved by the
    word's place and intersected.  ``slop > 0`` finds proximity matches: the words in order with at most ``slop``
    others between them, the nearest end of each beginning.

    Returns ``key, phrase_id, first_word, last_word`` (word numbers in the note, from 0) and ``gaps`` (0: exact), one row
    per phrase, note and place.  Phrases without words match nothing; phrases with equal words match alike.
    Phrases are searched in blocks of ``WINDOWS`` windows, however many there are.
    """
    if len({phrase_id, "key", "first_word", "last_word", "gaps"}) < 5:
        raise ValueError(f"{phrase_id} is a column of the result")
    windows, matches = _found(index, phrases, phrase_id, phrase, width, slop)
    notes = index.table.filter("term is null").select("segment", "no", "key")
    return matches.join(windows, "window").join(notes, ["segment", "no"]).select(
        "key", F.col("id").alias(phrase_id), "first_word", "last_word",
        (F.col("last_word") - F.col("first_word") + 1 - F.col("n")).alias("gaps"))


def contaminated_notes(events: DataFrame, phrases: DataFrame, key: str = "event_id", text: str = "notes",
                       phrase_id: str = "warning_id", phrase: str = "explanation", width: int = 10, slop: int = 0) -> DataFrame:
    """How much of every review note repeats the given phrases (by default the explanations of warnings).

    Words are runs of digits, letters and characters outside ASCII; A-Z are lower-cased.  The notes are
    indexed whole (:func:`index_notes`) and the phrases searched as in :func:`phrase_matches`; the index is
    deleted once the matches are stored.

    Returns one row per note: ``key, n_words, n_hit`` (words inside any match) and ``found``, the ids of the matching
    phrases as strings, sorted.  A null note or one without words has counts of 0.  A phrase without an id
    marks words but is not listed.  Rows that repeat a key, or have none, are notes of their own; an empty
    table gives no rows, and without phrases nothing is hit.  Further columns are not read.
    """
    if key in ("n_words", "n_hit", "found"):
        raise ValueError(f"{key} is a column of the result")
    index = index_notes(events, key, text)
    windows, matches = _found(index, phrases, phrase_id, phrase, width, slop)
    notes = cut_lineage(index.table.filter("term is null").select("segment", "no", "key", "words"))
    discard(index.table)
    # words that matches cover: the matches of a note are no more than its words times the phrases it holds
    spans = F.array_sort(F.collect_set(F.struct("first_word", "last_word")))
    start = F.struct(F.lit(0).alias("hit"), F.lit(-1).alias("end"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct(
        (a["hit"] + F.greatest(F.lit(0), s["last_word"] - F.greatest(s["first_word"] - 1, a["end"]))).alias("hit"),
        F.greatest(a["end"], s["last_word"]).alias("end")))
    hits = matches.groupBy("segment", "no").agg(spans.alias("spans")).select("segment", "no", covered["hit"].alias("hit"))
    named = matches.select("segment", "no", "window").distinct().join(windows, "window").groupBy("segment", "no").agg(
        F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("found"))
    none = F.array().cast("array<string>")
    return notes.join(hits, ["segment", "no"], "left").join(named, ["segment", "no"], "left").select(
        F.col("key").alias(key), F.col("words").cast("long").alias("n_words"),
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("found", none).alias("found"))
