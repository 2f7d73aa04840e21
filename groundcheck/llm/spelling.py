"""Spelling variants in review notes: words one edit apart, found in a reduced alphabet."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundcheck.lineage import cut_lineage, discard
from groundcheck.llm.words import byte_slices, find_words, mixed, powers, word_bytes

#: Bytes of text that a task counts at once.
COUNTED = 8 << 20
#: Neighbours that are made at once.
MADE = 1 << 20
#: Letters: a-z here, U+00C0 to U+00FF by their UTF-8 lead byte.
LETTERS = word_bytes((0x61, 0x7A))
LATIN = 0xC3

_SYMBOLS = np.random.default_rng(12).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _checksums(keys: list[str | None], text: np.ndarray, words: list[bytes], which: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``<key>:<word>`` for every occurrence (text number, word number).

    A CRC is linear: that of the joined bytes is that of the prefix, moved over as many zero bytes as the
    word has, combined with that of the word alone.
    """
    from zlib import crc32

    sizes = np.fromiter(map(len, words), np.int64, len(words))
    alone = np.fromiter((crc32(w, 0xFFFFFFFF) ^ 0xFFFFFFFF for w in words), np.uint32, len(words))
    # the prefixes of the texts, moved over 0, 1, 2, ... zero bytes
    moved = np.fromiter((crc32(f"{k}:".encode()) for k in keys), np.uint32, len(keys)) ^ np.uint32(0xFFFFFFFF)
    out = np.zeros(len(text), np.uint32)
    by_size = np.argsort(sizes[which], kind="stable")
    ends = np.searchsorted(sizes[which][by_size], np.arange(65), "right")
    for size in range(1, 65):
        moved = _CRC[moved & 255] ^ (moved >> 8)
        at = by_size[ends[size - 1]:ends[size]]
        out[at] = ~moved[text[at]] ^ alone[which[at]]
    for i in by_size[ends[64]:]:  # long words one by one
        out[i] = crc32(words[which[i]], crc32(f"{keys[text[i]]}:".encode()))
    return out


def count_words(events: DataFrame, key: str = "event_id", text: str = "notes", least_letters: int = 6,
                least_count: int = 5, slips: int | None = None) -> DataFrame:
    """``word, n``: how often every word of at least ``least_letters`` letters stands in the notes.

    Words are runs of ``A-Z a-z`` and U+00C0 to U+00FF; A-Z are lower-cased.  A task counts up to ``COUNTED``
    bytes of notes before the shuffle, so a word in a third of all notes sends one row per such part.

    With ``slips`` one occurrence in so many loses a letter first, as in careless typing: with ``h`` the
    CRC-32 of ``<key>:<word>``, the letter ``h % length`` goes where ``slips`` divides ``h``.  Notes without a key
    keep their words.  A null note has no words; repeated rows count again.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    def run(batches):
        for batch in byte_slices(batches, 1, COUNTED):
            found = find_words(batch.column(1), LETTERS, LATIN)
            leads = np.concatenate([[0], np.cumsum(found.data == LATIN)])
            letters = found.ends - found.starts - (leads[found.ends] - leads[found.starts])
            long = np.flatnonzero(letters >= least_letters)
            if not len(long):
                continue
            _, first, which = np.unique(found.hashes[long], return_index=True, return_inverse=True)
            starts, ends, size = found.starts[long][first], found.ends[long][first], letters[long][first]
            data = found.data.tobytes()
            words = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
            counts = np.bincount(which, minlength=len(words))
            slipped: Counter = Counter()
            if slips:
                keys = batch.column(0).to_pylist()
                at = found.text[long]
                h = _checksums(keys, at, words, which)
                hit = np.flatnonzero(h % slips == 0)
                hit = hit[[keys[t] is not None for t in at[hit]]] if len(hit) else hit
                counts -= np.bincount(which[hit], minlength=len(words))
                for w, c in zip(which[hit].tolist(), h[hit].tolist()):
                    if size[w] > least_letters:
                        word = words[w].decode()
                        gone = c % len(word)
                        slipped[word[:gone] + word[gone + 1:]] += 1
            kept = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i].decode() for i in kept] + list(slipped), pa.string()),
                 pa.array(np.concatenate([counts[kept], np.fromiter(slipped.values(), np.int64, len(slipped))]), pa.int64())],
                names=["word", "n"])

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def reduced(points: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol, 0 to ``symbols - 1``, of every code point."""
    return ((points.astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(13)) % np.uint64(symbols)


def neighbourhood(word: np.ndarray, symbols: int):
    """Own hash of reduced words of one length (rows of symbols), and arrays of those of their one-edit neighbours.

    The neighbourhood is full: every deletion, replacement and insertion of one symbol, and the word itself.
    It is made in pieces of about ``MADE`` hashes.
    """
    count, length = word.shape
    up, down = powers(length + 2)
    values = _SYMBOLS[:symbols]
    before = np.zeros((count, length + 1), np.uint64)
    np.cumsum(_SYMBOLS[word] * up[:length], axis=1, out=before[:, 1:])
    own = before[:, -1]

    def pieces():
        yield own[:, None]
        step = max(MADE // (count * symbols), 1)
        for low in range(0, length + 1, step):
            at = np.arange(low, min(low + step, length + 1))
            inner = at[at < length]
            tail = own[:, None] - before[:, at]
            if len(inner):
                yield before[:, inner] + (own[:, None] - before[:, inner + 1]) * down[1]
                other = (values[None, None, :] - _SYMBOLS[word[:, inner]][:, :, None]) * up[inner][None, :, None]
                yield (own[:, None, None] + other).reshape(count, -1)
            yield ((before[:, at] + tail * up[1])[:, :, None] + values[None, None, :] * up[at][None, :, None]).reshape(count, -1)

    return own, pieces()


def _reduced_groups(words: list[str], symbols: int):
    """Words of like length together, a bounded number at once: their places and symbols."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(sizes[order])) + 1), len(order)]
    for low, high in zip(cuts, cuts[1:]):
        length = int(sizes[order[low]])
        step = max(MADE // ((length + 1) * symbols * 2), 1)
        for at in range(low, high, step):
            which = order[at:min(at + step, high)]
            yield which, reduced(points[first[which][:, None] + np.arange(length)], symbols).astype(np.int64)


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """``a, b``: all pairs of distinct words that one inserted, deleted or replaced letter turns into each other, once.

    Letters are hashed to ``symbols`` symbols.  One edit of a word is at most one edit of its reduced form, so
    the reduced words' full one-edit neighbourhoods are joined with the reduced vocabulary (of a pair the
    side of the smaller hash is enough), and the words behind every pair of reduced words are compared.
    """
    def reduce(batches):
        for batch in batches:
            held = batch.column(0).to_pylist()
            own = np.zeros(len(held), np.uint64)
            for which, word in _reduced_groups(held, symbols) if held else ():
                own[which] = neighbourhood(word, symbols)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mixed(own).view(np.int64))], names=["word", "h"])

    def surround(batches):
        for batch in batches:
            held = batch.column(0).to_pylist()
            for which, word in _reduced_groups(held, symbols) if held else ():
                own, pieces = neighbourhood(word, symbols)
                mine = mixed(own).view(np.int64)
                for piece in pieces:
                    near = np.sort(mixed(piece).view(np.int64), axis=1)
                    keep = near >= mine[:, None]
                    keep[:, 1:] &= near[:, 1:] != near[:, :-1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(mine, keep.sum(axis=1))), pa.array(near[keep])], names=["h", "near"])

    vocabulary = cut_lineage(words.select("word").distinct().mapInArrow(reduce, "word string, h long"))
    one = vocabulary.groupBy("h").agg(F.min("word").alias("word"))
    around = one.select("word").mapInArrow(surround, "h long, near long")
    met = around.join(one.select(F.col("h").alias("near")), "near").distinct()
    a = vocabulary.select(F.col("h"), F.col("word").alias("a"))
    b = vocabulary.select(F.col("h").alias("near"), F.col("word").alias("b"))
    both = met.join(a, "h").join(b, "near").filter((F.col("h") < F.col("near")) | (F.col("a") < F.col("b")))
    # h <= near by construction: a pair in one reduced word is met once by a < b, another by its order of hashes
    found = both.filter((F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
    pairs = cut_lineage(found)
    discard(vocabulary)
    return pairs


def group_spellings(words: DataFrame, word: str = "word", count: str = "n", ratio: int = 5, symbols: int | None = None) -> DataFrame:
    """The usual spelling of every word of review notes (``word`` and how often it stands there, ``n``).

    Two words are near if exactly one inserted, deleted or replaced letter (code point) tells them apart.
    A word's ``form`` is its near word of the largest count (ties: the smallest in code-point order), if that is at
    least ``ratio`` times its own; its ``root`` is the last word reached over forms, itself if it has none.

    ``symbols`` is the size of the reduced alphabet (see :func:`near_words`); by default it grows with the sixth
    root of the vocabulary, from 4 to 32, so that few words of six letters or more share a reduced form.

    Returns ``word, form, root, n, n_near, form_n``, one row per word.  Rows without a word or count take no part;
    a repeated word's counts are added; an empty table gives no rows.  Further columns are not read.
    """
    known = cut_lineage(words.select(F.col(word).alias("word"), F.col(count).cast("long").alias("n"))
                        .filter("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")))
    if symbols is None:
        symbols = int(min(max(np.ceil((4.0 * known.count()) ** (1 / 6)), 4), 32))
    if not 1 <= symbols <= len(_SYMBOLS):
        raise ValueError(f"symbols may be 1 to {len(_SYMBOLS)}")
    pairs = near_words(known, symbols)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.join(known.select(F.col("word").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("form"))).alias("best"))
    formed = known.join(best.withColumnRenamed("a", "word"), "word", "left").withColumn("form_n", -F.col("best.m"))
    fits = F.col("form_n") >= ratio * F.col("n")
    table = cut_lineage(formed.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"),
        F.when(fits, F.col("form_n")).alias("form_n")))
    discard(pairs)
    # forms of forms: every round doubles the way, and counts grow along it, so it ends
    links = cut_lineage(table.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = cut_lineage(links.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = after.filter("moved").limit(1).count()
        discard(links)
        links = after.drop("moved")
        if not moved:
            break
    return table.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
