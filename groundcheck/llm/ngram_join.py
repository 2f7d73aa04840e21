"""Near-duplicate review notes: a Jaccard join on word n-grams by T-occurrence search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundcheck.lineage import cut_lineage, discard, release
from groundcheck.llm.bitmaps import bitmap, plausible
from groundcheck.llm.common import components, map_text, ranked, slices, small_batches
from groundcheck.llm.words import byte_slices

#: One text in so many is read to rank words and n-grams by how common they are.
SAMPLE = 16
#: Entries of each table of common words and n-grams (a bound on what is broadcast, not on what is joined).
COMMON = 1 << 17
#: Members that one part of an inverted list is meant to have.
PART = 256
#: Counts from which on words and n-grams are one bin when the most common are looked for.
COUNTS = 1 << 16
#: Notes that one block of a component is meant to have when links are counted.
BLOCK = 256
#: Members of an open list up to which its pairs are compared one by one.
SHORT = 256
#: Members that one block of a group of long open lists is meant to have.
SEARCHED = 1024
#: Rounds in which long open lists are compared with one of their members.
CENTRES = 2
#: Bytes of text, on one side, of the pairs that are compared at once.
VERIFIED = 2 << 20


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words: runs of anything but ASCII white space, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else []
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; the whole sequence as one if it is shorter."""
    size = min(width, len(words))
    count = len(words) - size + 1 if size else 0
    out = np.full(count, size * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for j in range(size):
        out = (out ^ words[j:j + count]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


class Ranks:
    """How common words and n-grams are in the sample; the same order everywhere, rare ones first."""

    def __init__(self, words: dict[str, np.ndarray], shingles: dict[str, np.ndarray]):
        self.words, self.shingles = words, shingles

    @staticmethod
    def _find(table: dict[str, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        keys, counts = table["keys"], table["counts"]
        if not len(keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, counts[at], 0)

    def order(self, words: np.ndarray, shingles: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams from rare to common, and the sampled count of each."""
        usual = np.rint(16 * np.log1p(self._find(self.words, words))).astype(np.int64)
        size = min(width, len(words))
        common = np.convolve(usual, np.ones(size, np.int64), "valid") if size else usual
        distinct, first = np.unique(shingles, return_index=True)
        counts = self._find(self.shingles, distinct)
        order = np.lexsort((distinct, common[first], counts))
        return distinct[order], counts[order]


def least_overlap(n: int, percent: int) -> int:
    """Shared n-grams that any partner of a set of ``n`` must reach."""
    return -(-n * percent // 100)


def nearly_top(counted: DataFrame, n: int) -> DataFrame:
    """The rows of the ``n`` largest ``c`` (at ties the smallest ``h``) and few others.

    A sort with a limit hands the first ``n`` rows of every task to the driver, so the others are left out before: first
    by a histogram of the counts, then, among those of the last count that is taken, by one of the hashes.
    """
    def last(rows: DataFrame, by, wanted: int, falling: bool) -> tuple[int | None, int]:
        """The bin in which the ``wanted``-th row lies (none: there are fewer rows) and how many of it are wanted."""
        for r in sorted(rows.groupBy(by.alias("bin")).count().collect(), key=lambda r: -r["bin"] if falling else r["bin"]):
            if wanted <= r["count"]:
                return r["bin"], wanted
            wanted -= r["count"]
        return None, wanted

    count, part = F.least("c", F.lit(COUNTS)), F.shiftright("h", 52)
    least, wanted = last(counted, count, n, True)
    if least is None:
        return counted
    if least == COUNTS:
        return counted.filter(F.col("c") >= COUNTS)
    most, _ = last(counted.filter(F.col("c") == least), part, wanted, False)
    return counted.filter((F.col("c") > least) | ((F.col("c") == least) & (part <= most)))


def _sampled(rows: DataFrame, width: int) -> Ranks:
    def counter():
        def run(texts):
            kinds, hashes, counts = [], [], []
            words = [word_hashes(t) for t in texts]
            for kind, sets in enumerate(([np.unique(w) for w in words],
                                         [np.unique(shingle_hashes(w, width)) for w in words])):
                h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
                kinds.append(np.full(len(h), kind, np.int32))
                hashes.append(h.view(np.int64))
                counts.append(n.astype(np.int64))
            return [np.concatenate(kinds), np.concatenate(hashes), np.concatenate(counts)], None
        return run

    # a copied text counts once
    sample = rows.select("t").filter(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0).groupBy("t").agg(
        F.lit(1).alias("_one")).select("t")
    counted = cut_lineage(map_text(sample, "t", counter, "kind int, h long, c long").groupBy("kind", "h").agg(
        F.sum("c").alias("c")).filter("c >= 2"))
    tables = []
    for kind, least in ((0, 2), (1, 3)):
        top = nearly_top(counted.filter((F.col("kind") == kind) & (F.col("c") >= least)).select("h", "c"), COMMON).orderBy(
            F.desc("c"), "h").limit(COMMON).toPandas()
        keys = top["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        tables.append({"keys": keys[order], "counts": top["c"].to_numpy(np.int64)[order]})
    return Ranks(*tables)


def _profiles(rows: DataFrame, ranks, width: int, percent: int) -> DataFrame:
    """Per row: set size, a hash of the whole set, its bitmap, and its short lists (the rarest n-grams) with their parts."""
    def profiler():
        from xxhash import xxh3_128_digest

        held = ranks.value

        def run(texts):
            sizes, nodes, bits, short, parts = [], [], [], [], []
            for t in texts:
                words = word_hashes(t)
                ordered, counts = held.order(words, shingle_hashes(words, width), width)
                n = len(ordered)
                sizes.append(n)
                nodes.append(xxh3_128_digest(np.sort(ordered).tobytes()))
                bits.append(bitmap(ordered))
                keep = n - least_overlap(n, percent) + 1 if n else 0
                short.append(ordered[:keep].view(np.int64))
                parts.append((1 + counts[:keep] * SAMPLE // PART).astype(np.int32))
            return [sizes, nodes, bits, short, parts], None

        return run

    return map_text(rows, "t", profiler, "n int, node binary, bits binary, short array<bigint>, parts array<int>")


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets share enough: one set's n-grams are probed in the other's sorted ones.

    Pairs that their bitmaps rule out (:func:`plausible`) never meet a text, and only the texts of the others are dealt.
    """
    def grams(t: str) -> np.ndarray:
        return np.unique(shingle_hashes(word_hashes(t), width))

    def probe(batches):
        sets, held = {}, 0  # of the texts met last: one id has one text, and pairs that meet in a list share ids

        def of(id_: int, text) -> np.ndarray:
            nonlocal held
            if id_ not in sets:
                if held > VERIFIED:
                    sets.clear()
                    held = 0
                sets[id_] = grams(text.as_py())
                held += sets[id_].nbytes
            return sets[id_]

        for whole in batches:
            for batch in byte_slices([whole], whole.schema.get_field_index("x"), VERIFIED):
                keep = []
                x, y = batch.column("x"), batch.column("y")
                for i, ids in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                    a, b = sorted((of(ids[0], x[i]), of(ids[1], y[i])), key=len)
                    shared = 0
                    if len(a):
                        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                        shared = int((b[at] == a).sum())
                    if (100 + percent) * shared >= percent * (len(a) + len(b)):
                        keep.append(i)
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    pairs = plausible(pairs, sketches, percent)
    if not pairs.limit(1).count():
        return pairs
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = cut_lineage(texts.join(asked, "id", "left_semi"))
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("t").alias("x")), "a").join(
        held.select(F.col("id").alias("b"), F.col("t").alias("y")), "b")
    with small_batches(pairs.sparkSession):
        links = cut_lineage(both.select("a", "b", "x", "y").mapInArrow(probe, "a long, b long"))
    discard(pairs, held)
    release(pairs.sparkSession)
    return links


def t_occurrence(query: np.ndarray, least: int, lists: dict[int, np.ndarray], count: int) -> np.ndarray:
    """How many n-grams of ``query`` each of ``count`` members has, where that may reach ``least``; else 0.

    ``lists`` are inverted lists (sorted member numbers) by n-gram.  Up to ``least - 1`` of the longest lists are
    set aside; the short ones are merged by counting, and a member that is in none of them can't reach
    ``least``.  The long lists are then probed by bisection for the members that are left.
    """
    held = sorted((lists[g] for g in query.tolist() if g in lists), key=len)
    aside = min(least - 1, len(held))
    counts = np.zeros(count, np.int64)
    short = held[:len(held) - aside]
    if short:
        counts = np.bincount(np.concatenate(short), minlength=count)
    found = np.flatnonzero(counts)
    for k, members in enumerate(held[len(held) - aside:]):
        found = found[counts[found] >= least - (aside - k)]  # what the lists still to come can add
        if not len(found):
            break
        at = np.minimum(np.searchsorted(members, found), len(members) - 1)
        counts[found] += members[at] == found
    out = np.zeros(count, np.int64)
    out[found] = counts[found]
    return out


def _searched(width: int, percent: int):
    """Links between the open members of two blocks of a group, as few as join the same components."""
    def search(group):
        grams = [np.unique(shingle_hashes(word_hashes(t), width)) for t in group["t"]]
        sizes, ids = np.array([len(g) for g in grams]), np.array(group["id"], np.int64)
        parts = {c: i for i, c in enumerate(dict.fromkeys(group["c"]))}
        top = np.array([parts[c] for c in group["c"]])  # the component of each, as far as it is known here
        block = np.array(group["block"])
        left = np.flatnonzero(block == group["i"][0])
        right = np.flatnonzero(block == group["j"][0])
        place = np.concatenate([np.full(len(grams[r]), n) for n, r in enumerate(right)]) if len(right) else np.zeros(0, np.int64)
        values = np.concatenate([grams[r] for r in right]) if len(right) else np.zeros(0, np.uint64)
        order = np.lexsort((place, values))
        values, place = values[order], place[order]
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        lists = dict(zip(values[heads].tolist(), np.split(place, heads[1:])))
        links = []
        for x in left:
            shared = t_occurrence(grams[x], least_overlap(int(sizes[x]), percent), lists, len(right))
            near = (100 + percent) * shared >= percent * (sizes[x] + sizes[right])
            for y in right[near & (top[right] != top[x])]:
                if top[y] != top[x]:
                    links.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
                    top[top == top[y]] = top[x]
        a, b = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        held, now = None, None
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                key = (row["group"], row["i"], row["j"])
                if key != now:
                    if held:
                        yield search(held)
                    held, now = {c: [] for c in row}, key
                for c, v in row.items():
                    held[c].append(v)
        if held:
            yield search(held)
    return run


def hot_links(rest: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among the members of long open lists: lists that share members form a group, searched block by block."""
    edges = rest.select(F.concat(F.lit("g"), F.col("gram").cast("string")).alias("src"),
                        F.concat(F.lit("n"), F.col("id").cast("string")).alias("dst"))
    groups = components(edges).filter("node like 'n%'").select(
        F.expr("cast(substr(node, 2) as bigint)").alias("id"), F.col("component").alias("group"))
    members = cut_lineage(rest.select("id", "c").distinct().join(groups, "id"))
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / SEARCHED).cast("int").alias("blocks"))
    dealt = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(texts, "id").select(
        "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "c", "t")
    keys = ["group", "i", "j"]
    with small_batches(rest.sparkSession):
        found = cut_lineage(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
            _searched(width, percent), "a long, b long").distinct())
    discard(members)
    return found


def _block_links(width: int, percent: int):
    """Per note of two blocks of a component the rows that it links to in the other (or in its own, if they are one)."""
    def count(group):
        grams = [np.unique(shingle_hashes(word_hashes(t), width)) for t in group["t"]]
        sizes, copies = np.array([len(g) for g in grams]), np.array(group["copies"], np.int64)
        values, at = np.unique(np.concatenate(grams), return_inverse=True)
        ends = np.cumsum(sizes)
        block, one = np.array(group["block"]), group["i"][0] == group["j"][0]
        left = np.flatnonzero(block == group["i"][0])
        right = left if one else np.flatnonzero(block == group["j"][0])
        links = np.zeros(len(grams), np.int64)
        if len(left) and len(right):
            own = np.concatenate([at[ends[r] - sizes[r]:ends[r]] for r in right])
            starts, marked = np.cumsum(sizes[right]) - sizes[right], np.zeros(len(values), np.int64)
            for x in left:
                mine = at[ends[x] - sizes[x]:ends[x]]
                marked[mine] = 1
                shared = np.add.reduceat(marked[own], starts)
                marked[mine] = 0
                near = ((100 + percent) * shared >= percent * (sizes[x] + sizes[right])) & (right != x)
                links[x] += copies[right[near]].sum()
                if not one:
                    links[right[near]] += copies[x]
        return pa.RecordBatch.from_arrays([pa.array(group["id"], pa.int64()), pa.array(links)], names=["id", "links"])

    def run(batches):
        held, now = None, None
        for batch in slices(batches):
            for row in batch.to_pylist():
                key = (row["component"], row["i"], row["j"])
                if key != now:
                    if held:
                        yield count(held)
                    held, now = {c: [] for c in row}, key
                for c, v in row.items():
                    held[c].append(v)
        if held:
            yield count(held)
    return run


def _counted(found: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``id, links``: all pairs inside every component are compared, block by block, so each text is read once a block."""
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = found.join(sizes, "component").withColumnRenamed("node", "id").join(
        nodes.select("id", "copies"), "id").join(texts, "id").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "t")
    keys = ["component", "i", "j"]
    return cut_lineage(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _block_links(width, percent), "id long, links long").groupBy("id").agg(F.sum("links").alias("links")))


def link_notes(events: DataFrame, key: str = "event_id", text: str = "notes", width: int = 5,
               percent: int = 80, count_links: bool = False) -> DataFrame:
    """Group the review notes that word n-grams of ``width`` link at a Jaccard similarity of ``percent`` or more.

    The join is exact.  A note of ``n`` distinct n-grams can only reach the overlap ``T`` with partners
    that share one of its ``n - T + 1`` shortest inverted lists, so only those are built and merged (a
    grouped merge on query and candidate); its other, long lists are not read through but probed: every
    candidate's sorted n-grams are searched by bisection, and pairs that reach ``T`` are kept.  Lists
    count as short by a sample's counts, which decide speed alone.

    * Every candidate pair is first bounded by the bitmaps of both sets; only pairs that may reach ``T`` get their texts.
    * Equal sets are one node.  Lists too long for one task are dealt in parts.
    * First every list's members are compared with its smallest and largest note, then those of long lists with
      the note of the most copies and one drawn by chance.  Where that has put a list's members in one
      component, its other pairs can add nothing and are skipped.
    * Of what is left, short lists are compared pair by pair.  Long lists that share members are searched in
      blocks by T-occurrence (:func:`t_occurrence`): short inverted lists are merged, long ones probed.

    Returns ``key, n_shingles, component``, the smallest key reachable over links, and with ``count_links``
    also ``links``: how many other rows are linked to the row, equal ones included.  As a link never
    leaves a component, all pairs of each component are compared for it, whatever they met in before.

    A null text or one without words has no n-grams, no links and its own key as component; a shorter
    text is one n-gram.  Rows without a key are linked like others, but give no component its name; rows
    that repeat a key are one row each; an empty table gives no rows.
    """
    note = F.col(text).cast("string")
    rows = events.select(F.col(key).alias("k"), F.xxhash64(note).alias("u"), note.alias("t"))
    ranks = rows.sparkSession.sparkContext.broadcast(_sampled(rows, width))
    with small_batches(rows.sparkSession):
        profiles = cut_lineage(_profiles(rows, ranks, width, percent))
    nodes, _ = ranked(profiles.filter("n > 0").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("k").alias("rep"), F.min(F.struct("k", "u")).alias("one")), [], ["n", "node"], "id")
    nodes = cut_lineage(nodes)
    release(rows.sparkSession)

    def of_node(df: DataFrame, which: DataFrame) -> DataFrame:
        """The row that stands for each node."""
        which = which.select("id", F.col("one.k").alias("_k"), F.col("one.u").alias("_u"))
        return df.join(which, F.col("k").eqNullSafe(F.col("_k")) & (F.col("u") == F.col("_u")))

    # inverted lists of the short n-grams, from one row of every node
    members = of_node(profiles, nodes).select("id", "n", F.explode(F.arrays_zip("short", "parts")).alias("l"))
    lists = members.groupBy(
        F.col("l.short").alias("gram"), F.col("l.parts").alias("parts"),
        F.pmod(F.xxhash64("id"), F.col("l.parts")).cast("int").alias("part")).agg(
        F.array_distinct(F.collect_list(F.struct("id", "n"))).alias("m"))
    lists = cut_lineage(lists.filter("size(m) > 1 or parts > 1"))

    def near(low: str, high: str):
        return F.col(low) * 100 >= F.col(high) * percent

    def pairs_of(pairs: DataFrame) -> DataFrame:
        return pairs.filter((F.col("x.id") != F.col("y.id")) & near("x.n", "y.n")).select(
            F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    low = lists.select("gram", "parts", "part", "m", F.array_min("m").alias("low"), F.array_max("m").alias("high"))
    stars = pairs_of(low.select(F.col("low").alias("x"), F.explode("m").alias("y"))).unionByName(
        pairs_of(low.select(F.explode("m").alias("x"), F.col("high").alias("y"))))
    split = low.filter("parts > 1").groupBy("gram").agg(F.min("low").alias("x"))
    stars = stars.unionByName(pairs_of(split.join(
        low.filter("parts > 1").select("gram", F.col("low").alias("y")), "gram")))
    stars = cut_lineage(stars.distinct())

    # texts of the nodes that meet in a list, one of each
    met = lists.select(F.explode("m.id").alias("id")).distinct().join(nodes, "id")
    texts = of_node(rows, met).select("id", "t")
    if profiles.groupBy("k", "u").agg(F.count("*").alias("c")).filter("c > 1").limit(1).count():
        texts = texts.dropDuplicates(["id"])
    texts = cut_lineage(texts)
    found = components(verified(stars, nodes, texts, width, percent), "a", "b")

    def joined(found: DataFrame, links: DataFrame) -> DataFrame:
        """The components of what was found and new links: a component enters as a star, not by all its links."""
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), "a", "b")

    def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
        """``rows`` with ``c``, the component of each member."""
        return rows.drop("c").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
            "c", F.coalesce("component", "id")).drop("component")

    def still_open(rows: DataFrame) -> DataFrame:
        """``gram, members`` of the lists whose members are not yet in one component."""
        return rows.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("members")).filter(
            "lo <> hi").select("gram", "members")

    held = placed(lists.select("gram", F.explode("m").alias("e")).select("gram", "e.id", "e.n"), found)
    rest = cut_lineage(held.join(still_open(held), "gram"))
    few, long = rest.filter(F.col("members") <= SHORT), rest.filter(F.col("members") > SHORT)
    # long open lists: compare all members with the one that most copies share, then with ones drawn by chance
    copies = nodes.select("id", "copies")
    for turn in range(CENTRES):
        if not long.limit(1).count():
            break
        rank = F.struct(-F.col("copies"), F.col("id")) if turn == 0 else F.struct(
            F.xxhash64("gram", "id", F.lit(turn)).alias("h"), F.col("id"))
        centre = long.join(copies, "id").groupBy("gram").agg(F.min_by(F.struct("id", "n", "c"), rank).alias("x"))
        pairs = long.join(centre, "gram").filter("c <> x.c").select(
            F.struct("id", "n").alias("x"), F.struct("x.id", "x.n").alias("y"))
        pairs = pairs_of(pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = joined(found, verified(pairs, nodes, texts, width, percent))
        # a list that is closed stays closed, so only these are looked at again
        moved = cut_lineage(placed(long, found))
        long = cut_lineage(moved.join(still_open(moved), "gram", "left_semi"))
    few = placed(few, found)
    release(rows.sparkSession)
    # the other pairs: of short lists one by one, of long ones by search in blocks
    x, y = (few.select("gram", F.struct("id", "n").alias(s), F.col("c").alias(f"c{s}")) for s in "xy")
    more = pairs_of(x.join(y, "gram").filter("x.id < y.id and cx <> cy")).distinct().join(stars, ["a", "b"], "left_anti")
    more = cut_lineage(more)
    links = verified(more, nodes, texts, width, percent)
    if long.limit(1).count():
        links = links.unionByName(hot_links(long, texts, width, percent))
    discard(more, rest, stars, lists)
    found = joined(found, links)

    named = nodes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    if count_links:
        named = named.drop("component").join(_counted(found, nodes, texts, width, percent), "id", "left").withColumn(
            "links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    discard(texts)
    out = ["links"] if count_links else []
    named = named.select("node", "rep", "c", *out)
    first = named.groupBy("c").agg(F.min("rep").alias("component"))
    named = named.join(first, "c").select(F.col("node").alias("_node"), "component", *out)
    return profiles.select("k", "n", "node").join(named, F.col("node") == F.col("_node"), "left").select(
        F.col("k").alias(key), F.col("n").cast("long").alias("n_shingles"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in out),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("k")).alias("component"))
