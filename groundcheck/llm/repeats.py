"""Byte strings that repeat in review notes: range-partitioned suffixes, sorted in buckets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundcheck.lineage import cut_lineage, discard
from groundcheck.llm.common import map_text, slices

_CHUNK = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place (along the last axis), by joining halves."""
    power = _mix((data.astype(np.uint64) + np.uint64(1)) * _A)
    out, at, width = None, 0, 1
    n = data.shape[-1] - size + 1
    while True:
        if size & width:
            part = power[..., at:at + n]
            out = part.copy() if out is None else _mix(out * _A + part)
            at += width
        width *= 2
        if width > size:
            return out
        half = width // 2
        power = _mix(power[..., :-half] * _A + power[..., half:])


def window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` hashes the place of its smallest one, the leftmost of equals."""
    place, value, have = np.arange(len(hashes), dtype=np.int32), hashes, 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        value = np.where(right, value[step:], value[:-step])
        place = np.where(right, place[step:], place[:-step])
        have += step
    return place


def _packed(first, before, windows):
    """Place of an anchor: its first window, the bytes before it there, and its windows less one."""
    return (first.astype(np.int64) << 24) | (before.astype(np.int64) << 12) | windows.astype(np.int64)


def _unpacked(pos: int) -> tuple[int, int, int]:
    return pos >> 24, (pos >> 12) & 0xFFF, pos & 0xFFF


def _anchor_rows(length: int):
    size = length // 2

    def chunk(parts, places):
        data = np.frombuffer(b"".join(parts), np.uint8)
        grams = gram_hashes(data, size)
        whole = _mix(grams[:-size] * _A + grams[size:])  # of the string from every place
        anchor = window_anchors(grams, length - size + 1)
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(parts)), sizes)[:len(whole)]
        valid = np.flatnonzero(np.arange(len(whole)) + length <= (starts + sizes)[doc])
        if not len(valid):
            return None
        a, d = anchor[valid], doc[valid]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
        first, last = valid[new], valid[np.concatenate([new[1:], [len(valid)]]) - 1]
        at = a[new]
        before, more = at - first, last - first
        context = _mix(_mix(whole[first] * _A + whole[last]) * _A + (before * 4096 + more).astype(np.uint64))
        d = d[new]
        return (grams[at].view(np.int64), context.view(np.int64),
                _packed(first - starts[d], before, more), np.asarray(places)[d])

    def make():
        def run(texts):
            out, parts, places, total = [], [], [], 0
            for i, t in enumerate(texts):
                raw = t.encode() if t else b""
                if len(raw) >= length:
                    parts.append(raw)
                    places.append(i)
                    total += len(raw)
                if parts and (total >= _CHUNK or i == len(texts) - 1):
                    out.append(chunk(parts, places))
                    parts, places, total = [], [], 0
            if parts:
                out.append(chunk(parts, places))
            out = [o for o in out if o]
            if not out:
                return [[], [], []], []
            columns = [np.concatenate(c) for c in zip(*out)]
            return columns[:3], columns[3]

        return run

    return make


def multikey_sort(keys: list[bytes]) -> np.ndarray:
    """Order of byte strings: sorts by eight bytes at a time, and goes on only within runs of equals."""
    n, width = len(keys), max((len(k) for k in keys), default=0)
    words = -(-(width + 1) // 8)
    table = np.zeros((n, words * 8), np.uint8)
    for i, k in enumerate(keys):
        table[i, :len(k)] = np.frombuffer(k, np.uint8)
        table[i, -1] = 0
    sizes = np.array([len(k) for k in keys], np.int64)
    order, blocks = np.arange(n), [(0, n)]
    view = table.view(">u8")
    for word in range(words):
        following = []
        for a, b in blocks:
            part = order[a:b]
            by = np.argsort(view[part, word], kind="stable")
            order[a:b] = part = part[by]
            cut = np.flatnonzero(np.diff(view[part, word].astype(np.uint64)) != 0) + 1
            edges = [a, *(a + cut).tolist(), b]
            following += [(x, y) for x, y in zip(edges, edges[1:]) if y - x > 1]
        blocks = following
        if not blocks:
            return order
    for a, b in blocks:  # equal but for zero bytes at the end: the shorter first
        part = order[a:b]
        order[a:b] = part[np.argsort(sizes[part], kind="stable")]
    return order


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _suffixes(length: int):
    def run(batches):
        for batch in slices(batches):
            u, n, where, gram, left, suffix = [], [], [], [], [], []
            for i, (t, edges) in enumerate(zip(batch.column("t").to_pylist(), batch.column("edge").to_pylist())):
                raw = t.encode()
                for e in edges:
                    first, before, more = _unpacked(e["pos"])
                    u.append(batch.column("u")[i].as_py())
                    n.append(batch.column("n")[i].as_py())
                    where.append(e["pos"])
                    gram.append(e["gram"])
                    left.append(raw[first:first + before])
                    suffix.append(raw[first + before:first + more + length])
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(n, pa.int32()), pa.array(where, pa.int64()),
                 pa.array(gram, pa.int64()), pa.array(left, pa.binary()), pa.array(suffix, pa.binary())],
                names=["u", "n", "pos", "gram", "left", "suffix"])
    return run


def _bucket(batches):
    """Sort one bucket and give every suffix its longest match with a neighbour; the ends are told apart."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    keys = table.column("suffix").to_pylist()
    order = multikey_sort(keys)
    match = np.zeros(len(keys), np.int64)
    for x, y in zip(order, order[1:]):
        same = common_prefix(keys[x], keys[y])
        match[x], match[y] = max(match[x], same), max(match[y], same)
    end = np.zeros(len(keys), np.int64)
    end[order[0]] += 1
    end[order[-1]] += 2
    for b in table.append_column("match", pa.array(match, pa.int32())).append_column(
            "end", pa.array(end, pa.int32())).to_batches(max_chunksize=4096):
        yield b


def _windows(length: int):
    size = length // 2

    def run(batches):
        for batch in slices(batches):
            pos = batch.column("pos").to_numpy()
            left, suffix = batch.column("left").to_pylist(), batch.column("suffix").to_pylist()
            match = batch.column("match").to_numpy()
            out = []
            for a in range(0, len(pos), 512):
                part = range(a, min(a + 512, len(pos)))
                data = [left[i] + suffix[i] for i in part]
                width = max(map(len, data))
                grid = np.zeros((len(data), width), np.uint8)
                for j, d in enumerate(data):
                    grid[j, :len(d)] = np.frombuffer(d, np.uint8)
                grams = gram_hashes(grid, size)
                whole = _mix(grams[:, :-size] * _A + grams[:, size:])
                for j, i in enumerate(part):
                    first, before, more = _unpacked(int(pos[i]))
                    count = min(more, before + int(match[i]) - length) + 1
                    if count > 0:
                        at = np.arange(count)
                        out.append((np.full(count, i), before - at, whole[j, :count].view(np.int64), first + at))
            rows, offset, string, start = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("u", "n", "gram")), pa.array(offset, pa.int32()),
                 pa.array(string, pa.int64()), pa.array(start, pa.int32())],
                names=["u", "n", "gram", "before", "string", "start"])
    return run


def _removed(length: int):
    def run(batches):
        for batch in slices(batches):
            spans, digests = [], []
            for t, whole, starts in zip(*(batch.column(c).to_pylist() for c in ("t", "whole", "starts"))):
                raw = t.encode()
                edge = np.zeros(len(raw) + 1, np.int32)
                for pos in whole or ():
                    first, _, more = _unpacked(pos)
                    edge[first] += 1
                    edge[first + more + length] -= 1
                for p in starts or ():
                    edge[p] += 1
                    edge[p + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(flips[::2], flips[1::2])])
                digests.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("n"),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(digests, pa.string())], names=["k", "n", "spans", "kept_sha256"])
    return run


def repeated_spans(events: DataFrame, key: str = "event_id", text: str = "notes", length: int = 200) -> DataFrame:
    """Every byte of a note that lies in a string of ``length`` bytes which starts at another place too.

    A suffix array of all places would be many times the input, so only the suffixes at anchors are kept:
    the anchor of a string is the place of the smallest hash of ``length / 2`` bytes within it, which equal
    strings share.  Anchors whose half-length hash occurs once need no further look.  Those left that agree in
    all bytes their strings cover settle by counting.  Of the others one each is kept with its bytes: these
    suffixes are dealt to buckets by range (splitters from a sample), sorted there eight bytes at a time,
    and compared with their neighbours, over the buckets' ends too; the longest match with a neighbour
    bounds the strings that can repeat, and only those are counted.

    Strings are compared by hashes of 128 bits in all.  ``length`` must be even, and below 4096.

    Returns ``key, n_bytes, spans (maximal removed runs of byte places, start and end), kept_sha256`` of the
    remaining bytes.  Matches lie within one note each, in the same or in different notes.

    A null note is empty; notes shorter than ``length`` lose nothing; equal notes of that length or more lose all; rows that
    repeat a key are notes of their own; an empty table gives no rows.
    """
    if length % 2 or not 2 <= length < 4096:
        raise ValueError("length must be even and below 4096")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = events.select(F.col(key).alias("k"), F.xxhash64(t).alias("u"), F.octet_length(t).alias("n"), t.alias("t"))
    anchors = map_text(rows.select("u", "n", "t"), "t", _anchor_rows(length), "gram long, context long, pos long")
    # the counts are stored apart, so that Spark may split a hot hash when it joins them
    twice = cut_lineage(anchors.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram"))
    live = cut_lineage(anchors.join(twice, "gram"))
    kinds = cut_lineage(live.groupBy("gram", "context").agg(
        F.count("*").alias("c"), F.min(F.struct("u", "n", "pos")).alias("one")))
    whole = live.join(kinds.filter("c > 1").select("gram", "context"), ["gram", "context"]).groupBy("u", "n").agg(
        F.collect_set("pos").alias("whole"))
    several = cut_lineage(kinds.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram"))
    edge = kinds.join(several, "gram").groupBy("one.u", "one.n").agg(
        F.collect_set(F.struct("gram", "one.pos")).alias("edge"))
    asked = whole.join(edge, ["u", "n"], "full")
    read = rows.join(asked, ["u", "n"], "left")
    open_ = F.col("whole").isNotNull() | F.col("edge").isNotNull()
    read = cut_lineage(read.select(
        "k", "u", "n", "whole", "edge", F.when(open_, F.col("t")).alias("t"),
        F.when(~open_, F.sha2(F.col("t"), 256)).alias("kept_sha256")))
    discard(twice, live, kinds, several)

    suffixes = cut_lineage(read.filter("edge is not null").select("u", "n", "t", "edge").dropDuplicates(["u", "n"])
                           .mapInArrow(_suffixes(length), "u long, n int, pos long, gram long, left binary, suffix binary"))
    sorted_ = cut_lineage(suffixes.repartitionByRange("suffix", "left").mapInArrow(
        _bucket, "u long, n int, pos long, gram long, left binary, suffix binary, match int, end int"))
    discard(suffixes)
    ends = sorted_.filter("end > 0").select("u", "n", "pos", "suffix", "left", "match", "end").collect()
    matched = sorted_.join(F.broadcast(_over_ends(sorted_, ends)), ["u", "n", "pos"], "left").withColumn(
        "match", F.greatest("match", F.coalesce("over", F.lit(0))))
    windows = cut_lineage(matched.select("u", "n", "pos", "gram", "left", "suffix", "match").mapInArrow(
        _windows(length), "u long, n int, gram long, before int, string long, start int"))
    discard(sorted_)
    again = cut_lineage(windows.groupBy("gram", "before", "string").agg(F.count("*").alias("c")).filter("c > 1").drop("c"))
    starts = windows.join(again, ["gram", "before", "string"]).groupBy("u", "n").agg(
        F.collect_set("start").alias("starts"))

    found = read.filter("t is not null").join(starts, ["u", "n"], "left").select("k", "n", "t", "whole", "starts").mapInArrow(
        _removed(length), f"k {rows.schema['k'].dataType.simpleString()}, n int, "
                          "spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
    clean = read.filter("t is null").select(
        "k", "n", F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), "kept_sha256")
    return found.unionByName(clean).select(F.col("k").alias(key), F.col("n").cast("long").alias("n_bytes"), "spans",
                                           "kept_sha256")


def _over_ends(df: DataFrame, ends: list) -> DataFrame:
    """Matches of each bucket's last suffix with the next bucket's first: two rows per bucket at most."""
    order = sorted(ends, key=lambda r: (bytes(r["suffix"]), bytes(r["left"])))
    best: dict = {}
    for x, y in zip(order, order[1:]):
        same = common_prefix(bytes(x["suffix"]), bytes(y["suffix"]))
        for r in (x, y):
            at = (r["u"], r["n"], r["pos"])
            best[at] = max(best.get(at, 0), same)
    return df.sparkSession.createDataFrame([(*at, m) for at, m in best.items()], "u long, n int, pos long, over int")
