"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else. Suffixes are not sorted at every
byte: of each window of `length` bytes, the q-gram with the least hash (the leftmost of ties) is its anchor, so equal
windows have equal anchors at equal places.

1. Texts are made distinct. Every anchor opens a bucket named by its q-gram; buckets of one place are final.
2. The windows of the other buckets are refined: a bucket is sorted by the identifiers of the q-grams at later offsets,
   which name the parts. Parts of one window are final and drop out; the rest are refined again, by the identifiers of
   the remaining offsets, until the whole window is compared. Identifiers are computed once and used in every round.
3. Windows left with others are repeated; their runs are the removed spans.

A bucket of more than `hot` places is refined in parts. Each part also gives one place of each of its distinct windows,
and these meet by the identifiers of the whole window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_CODE, mix, powers, slices, text_buffer

LENGTH, GRAM, HOT = 200, 64, 20_000
#: Bytes worked on at once: a slice's windows take some hundred times as many.
SLICE = 1 << 18
#: Bits of a composite minimum that hold the place within a slice; the rest are of the hash.
PLACE = np.uint64(27)
BASES = (BASE, np.uint64(0xD1342543DE82EF95))


def gram_names(data: np.ndarray, q: int, which: int = 0) -> np.ndarray:
    """A 64-bit identifier of the q-gram at each place that has one."""
    n = len(data)
    if n < q:
        return np.zeros(0, np.uint64)
    base = BASES[which]
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(n, base)[:n], out=run[1:])
    names = run[q:] - run[:-q]
    names *= powers(n, np.uint64(pow(int(base), -1, 2**64)))[: n - q + 1]
    return mix(names)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i that has w values."""
    out, k = x, 1
    while 2 * k <= w:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - k :][: len(x) - w + 1]) if w > k else out[: len(x) - w + 1]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Row, name, place, and first and last window start of every anchor; places count from the row's start."""
    size = np.diff(offsets)
    w = length - q + 1
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) >> int(PLACE):
        raise ValueError("a text of 128 MB or more")
    names = gram_names(data, q)
    mask = (np.uint64(1) << PLACE) - np.uint64(1)
    least = sliding_min((names & ~mask) | np.arange(len(names), dtype=np.uint64), w)
    fits = np.maximum(size - length + 1, 0)
    start = np.repeat(offsets[:-1] - (np.cumsum(fits) - fits), fits) + np.arange(fits.sum())
    place = (least[start] & mask).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]) if len(place) else np.zeros(1, np.int64)
    first, last = edge[:-1], edge[1:] - 1
    at = place[first]
    row = np.searchsorted(offsets, at, "right") - 1
    return row, names[at], at - offsets[row], start[first] - offsets[row], start[last] - offsets[row]


def anchor_rows(texts: DataFrame, length: int, q: int) -> DataFrame:
    """(h, k1, k2, pos, lo, hi) of the anchors of texts (k1, k2, text)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j in slices(b.column("text"), SLICE):
                part = b.slice(i, j - i)
                row, h, pos, lo, hi = anchors(*text_buffer(part.column("text")), length, q)
                k1, k2 = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k1), pa.array(k2), *[pa.array(x.astype(np.int32)) for x in (pos, lo, hi)]], ["h", "k1", "k2", "pos", "lo", "hi"])

    return texts.mapInArrow(run, "h long, k1 long, k2 long, pos int, lo int, hi int")


def shared_anchors(rows: DataFrame, hot: int) -> DataFrame:
    """The rows of buckets that have more than one place, with a part of the bucket: 0, or one of as many parts of about
    `hot` rows as a larger bucket needs (`big`). Counts are formed before the shuffle; a hot bucket's side of the join is
    split by adaptive execution."""
    counts = rows.select("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    x = rows.join(counts, "h").withColumn("big", F.col("n") > hot)
    part = F.when(F.col("big"), F.pmod(F.xxhash64("k1", "k2", "pos"), F.ceil(F.col("n") / hot))).otherwise(F.lit(0)).cast("int")
    return x.withColumn("part", part).drop("n")


def window_starts(lo: np.ndarray, hi: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and place in the buffer of every window of contexts that begin at `begin`."""
    n = hi - lo + 1
    of = np.repeat(np.arange(len(n)), n)
    return of, np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def refine(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, pos: np.ndarray, data: np.ndarray, begin: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and start (from the context's begin) of the windows that occur more than once in their buckets."""
    of, at = window_starts(lo, hi, begin)
    offset = (pos[of] - lo[of]) - (at - begin[of])  # of the anchor in the window; equal windows have it equal
    bucket = mix(h[of] ^ mix(offset.astype(np.uint64)))
    later = sorted({*range(0, length - q + 1, q), length - q})
    rounds = (later[: (len(later) + 1) // 2], later)
    keys = []
    for which, offsets in enumerate(rounds):
        names = gram_names(data, q, which)
        for d in offsets:
            bucket = mix(bucket ^ (names[at + d] + np.uint64(d + 1)))
        order = np.argsort(bucket, kind="stable")
        x = bucket[order]
        same = x[1:] == x[:-1]
        for key in (*keys, h[of].view(np.int64), offset):  # a part's windows agree in all that came before
            same &= key[order][1:] == key[order][:-1]
        live = np.zeros(len(x), bool)
        live[1:] |= same
        live[:-1] |= same
        keep = np.sort(order[live])
        of, at, offset, bucket = of[keep], at[keep], offset[keep], bucket[keep]
        keys = [k[keep] for k in keys] + [bucket]
    return of, at - begin[of]


def _runs(of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first and last of the runs of consecutive starts."""
    if not len(of):
        return of, start, start
    edge = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1), True])
    return of[edge[:-1]], start[edge[:-1]], start[edge[1:] - 1]


def contexts(rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """rows with `bytes`: the text from the anchor's first window's start to its last window's end."""
    lists = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "part", "big", "pos", "lo", "hi")).alias("marks"))  # of one text
    both = texts.join(lists, ["k1", "k2"])

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for i, j in slices(whole.column("text"), SLICE):
                b = whole.slice(i, j - i)
                data, offsets = text_buffer(b.column("text"))
                marks = b.column("marks")
                n = np.diff(np.asarray(marks.offsets))
                row = np.repeat(np.arange(len(n)), n)
                flat = marks.flatten()
                h, pos, lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h", "pos", "lo", "hi"))
                part, big = flat.field("part"), flat.field("big")
                size = hi.astype(np.int64) - lo + length
                stop = np.cumsum(size)
                at = np.repeat(offsets[row] + lo - (stop - size), size) + np.arange(size.sum())
                raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, stop].astype(np.int32)), pa.py_buffer(data[at])])
                k1, k2 = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays([pa.array(h), part, big, pa.array(k1), pa.array(k2), pa.array(pos), pa.array(lo), pa.array(hi), raw], ["h", "part", "big", "k1", "k2", "pos", "lo", "hi", "bytes"])

    return both.mapInArrow(run, "h long, part int, big boolean, k1 long, k2 long, pos int, lo int, hi int, bytes binary")


def whole_names(h: np.ndarray, of: np.ndarray, at: np.ndarray, data: np.ndarray, length: int, q: int) -> list[np.ndarray]:
    """Two 64-bit identifiers of each window."""
    out = []
    for which in (0, 1):
        names, key = gram_names(data, q, which), mix(h[of])
        for d in sorted({*range(0, length - q + 1, q), length - q}):
            key = mix(key ^ (names[at + d] + np.uint64(d + 1)))
        out.append(key)
    return out


RUNS = "kind int, w1 long, w2 long, k1 long, k2 long, first int, last int"


def repeated_windows(rows: DataFrame, length: int, q: int) -> DataFrame:
    """Runs of starts of windows that occur more than once in their part of a bucket (kind 0), and of the parts of big
    buckets one place of each distinct window (kind 1), named by w1 and w2.

    Rows pass by sorted; the last part of a bucket in a batch waits for the next.
    """

    def solve(table):
        import pyarrow as pa

        table = table.combine_chunks()
        k1, k2, h, pos, lo, hi, part, big = (table.column(c).to_numpy() for c in ("k1", "k2", "h", "pos", "lo", "hi", "part", "big"))
        data, begin = text_buffer(table.column("bytes"))
        begin = begin[:-1]
        bucket = h.view(np.uint64) + mix(part.astype(np.uint64) + np.uint64(1))
        lo, hi, pos = lo.astype(np.int64), hi.astype(np.int64), pos.astype(np.int64)
        of, start = refine(bucket, lo, hi, pos, data, begin, length, q)
        of, a, z = _runs(of, start)
        cols = [np.zeros(len(of), np.int32), k1[of], k2[of], k1[of], k2[of], (lo[of] + a).astype(np.int32), (lo[of] + z).astype(np.int32)]
        if big.any():
            some = np.flatnonzero(big)
            of, at = window_starts(lo[some], hi[some], begin[some])
            of = some[of]
            w1, w2 = whole_names(h.view(np.uint64), of, at, data, length, q)
            order = np.lexsort((w2, w1, bucket[of]))
            fresh = np.ones(len(order), bool)
            for x in (w1, w2, bucket[of]):
                x = x[order]
                fresh[1:] &= x[1:] == x[:-1]
            fresh[1:] = ~fresh[1:]
            one = order[fresh]
            of, s = of[one], (lo[of[one]] + at[one] - begin[of[one]]).astype(np.int32)
            more = [np.ones(len(of), np.int32), w1[one].view(np.int64), w2[one].view(np.int64), k1[of], k2[of], s, s]
            cols = [np.concatenate(c) for c in zip(cols, more)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "w1", "w2", "k1", "k2", "first", "last"])

    def run(batches):
        import pyarrow as pa

        held, size = [], 0
        for whole in batches:
            for i, j in slices(whole.column("bytes"), SLICE):
                b = whole.slice(i, j - i)
                if not b.num_rows:
                    continue
                if size > SLICE:  # all but the last part of a bucket is complete
                    table = pa.Table.from_batches(held)
                    h, part = table.column("h").to_numpy(), table.column("part").to_numpy()
                    other = np.flatnonzero((h != h[-1]) | (part != part[-1]))
                    if len(other):
                        cut = int(other[-1]) + 1
                        yield solve(table.slice(0, cut))
                        held = table.slice(cut).to_batches()
                        size = sum(int(text_buffer(x.column("bytes"))[1][-1]) for x in held)
                held.append(b)
                size += int(text_buffer(b.column("bytes"))[1][-1])
        if held:
            yield solve(pa.Table.from_batches(held))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "h", "part").sortWithinPartitions("h", "part").mapInArrow(run, RUNS)


def across_parts(runs: DataFrame) -> DataFrame:
    """Runs of kind 0, and those of kind 1 whose window another part of the bucket has too: no window has more rows than
    its bucket has parts."""

    def run(batches):
        import pyarrow as pa

        held, given = None, False
        for b in batches:
            if not b.num_rows:
                continue
            whole = pa.Table.from_batches(([held] if held is not None else []) + [b]).combine_chunks()
            kind, w1, w2 = (whole.column(c).to_numpy() for c in ("kind", "w1", "w2"))
            same = (kind[1:] == 1) & (kind[:-1] == 1) & (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
            give = kind == 0
            give[1:] |= same
            give[:-1] |= same
            was = given
            given = bool(give[-1]) if len(kind) > 1 or held is None else given
            if held is not None and was:
                give[0] = False
            if give.any():
                yield from whole.filter(pa.array(give)).select(["k1", "k2", "first", "last"]).to_batches()
            held = whole.slice(len(kind) - 1).combine_chunks().to_batches()[0]

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts, "w1", "w2").sortWithinPartitions("kind", "w1", "w2").mapInArrow(run, "k1 long, k2 long, first int, last int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = GRAM, hot: int = HOT, kept_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes), and with
    kept_text the remaining bytes as `kept` (binary: a span may end within a character).

    Texts are UTF-8 bytes, null is empty; matches never cross texts. Texts that several rows have repeat as a whole, if
    they have `length` bytes; shorter ones have nothing to remove. An empty table has no rows. A text of 128 MB or more is
    an error, as places in a text have 27 bits.
    """
    import hashlib

    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    x = x.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit("second"), "text"))
    # Equal texts meet before the shuffle. One plan reads the shuffled texts four times; no reader drops a column of
    # them, as then they would be shuffled again.
    texts = x.groupBy("k1", "k2").agg(F.max("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    marks = shared_anchors(anchor_rows(texts, length, q), hot)
    found = across_parts(repeated_windows(contexts(marks, texts, length), length, q))
    spans = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # of one text

    def cut(batches):
        import pyarrow as pa

        names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept_text
        for b in batches:
            out = []
            for text, copies, spans in zip(b.column("text"), b.column("copies").to_pylist(), b.column("spans")):
                raw = text.as_py().encode()
                n = len(raw)
                gone = np.zeros(n + 1, np.int32)
                if copies > 1 and n >= length:
                    gone[0], gone[n] = 1, -1
                elif spans.is_valid:
                    first, last = (spans.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
                    np.add.at(gone, first, 1)
                    np.add.at(gone, last + length, -1)
                gone = np.cumsum(gone[:n]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                begins = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((n, int(gone.sum()), begins, hashlib.sha256(kept).hexdigest(), kept if kept_text else None))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), *[pa.array(cols[k], pa.int64()) for k in range(3)], pa.array(cols[3], pa.string())] + [pa.array(cols[4], pa.binary())] * kept_text, names
            )

    joined = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "spans")
    done = joined.mapInArrow(cut, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text)
    return x.select("doc_id", "k1", "k2").join(done, ["k1", "k2"]).drop("k1", "k2")
