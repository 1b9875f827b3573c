"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

Words are lower-cased (A-Z) runs of other than ASCII white space; a document is its set of k-word shingles.

1. A sketch of fixed size counts all words. A shingle's rarity is estimated by the counts of its words; that, then a hash,
   orders the shingles, rare ones first. Any order that all documents share gives the same links; as the sketch tells
   frequent words from rare ones at any size, so does the order for shingles.
2. Documents with the same words are one class. Of each class, the first n - ceil(t n) + l shingles in that order are its
   prefix, with l = 1 + n / 100; two sets that link share at least the smaller l of their prefixes' shingles. Shingles of
   one class alone drop out.
3. In each bucket of a shared shingle, classes meet the bucket's first class only (length and positional filters). Pairs
   that meet often enough are verified; their components are found.
4. In the buckets that still hold several components, each class meets the class of another component that looks nearest,
   and components are merged, over again while a round joins half as many components as it verifies pairs. Then all
   pairs between different components that pass the filters and haven't been verified yet are verified.

Pairs within a component would change nothing, so they are never made: a large group of near copies costs rows by its
size, not its square, and no link between documents that are not yet together is lost. A bucket above a size is dealt out
in blocks, one task's work for each pair of blocks. The suffix filter works on a sketch of each set, the parities of its
shingles in 1024 classes: two sets differ in at least as many shingles as their parities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialize, mix, shingle_hashes, slices, store, text_buffer, word_bounds, word_hashes
from .components import connected_components

#: Slots of the sketch (fixed), and of a part of it.
SLOTS, PART = 1 << 22, 1 << 16
SLICE = 1 << 18
#: Bits of a hash that name its slot, and its place behind the six bits of a token's level.
SLOT_BITS = 22
#: 64-bit words of a set's parity sketch.
WORDS = 16
#: Rows of a bucket that are compared within one task; a larger bucket is dealt out in pairs of blocks of this size.
BUCKET = 1 << 14
#: Bits of the filter of wanted ids: its size is fixed.
FILTER = 1 << 24
#: Members that are held against a hub in one group.
BLOCK = 256
LOW = -(2**63)
SKETCH = [f"parity{w}" for w in range(WORDS)]


def hashes_of(column, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, their number in each row, and word hashes with theirs."""
    data, offsets = text_buffer(column)
    starts, ends, counts = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, True)
    return *shingle_hashes(words, counts, k), words, counts


def class_ids(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's sequence of words: sums of hashes of (word, place)."""
    place = (np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    out = []
    for salt in (0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D):
        run = np.r_[np.uint64(0), np.cumsum(mix(words ^ mix(place + np.uint64(salt))))]
        stop = np.cumsum(counts)
        out.append(mix(run[stop] - run[stop - counts] + counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def token_sets(hashes: np.ndarray, number: np.ndarray, level: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each row in rising order, and their number. A token is a shingle's level and 58 bits of its hash."""
    row = np.repeat(np.arange(len(number)), number)
    token = hashes >> np.uint64(6)
    if level is not None:
        token |= level << np.uint64(58)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return token[fresh], np.bincount(row[fresh], minlength=len(number))


def count_levels(docs: DataFrame) -> np.ndarray:
    """log2 of the count, in 64ths up to 40, of each slot of the sketch over all words of docs (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            for i, j in slices(b.column("text"), SLICE):
                data, offsets = text_buffer(b.column("text").slice(i, j - i))
                starts, ends, _ = word_bounds(data, offsets)
                slot, times = np.unique((word_hashes(data, starts, ends, True) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), return_counts=True)
                total = np.zeros(SLOTS, np.int64) if total is None else total
                total[slot] += times
        slot = np.flatnonzero(total) if total is not None else np.zeros(0, np.int64)
        for part in np.unique(slot // PART):
            own = slot[slot // PART == part]
            row = [[part], [(own % PART).astype("<u2").tobytes()], [total[own].astype("<i8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.binary())], ["part", "slots", "counts"])

    def add(batches):
        import pyarrow as pa

        part, total = None, None

        def give():
            levels = np.minimum(np.log2(np.maximum(total, 1)) * 6.4, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["part", "levels"])

        for b in batches:
            for p, slots, counts in zip(b.column("part").to_pylist(), b.column("slots"), b.column("counts")):
                if p != part:
                    if part is not None:
                        yield give()
                    part, total = p, np.zeros(PART, np.int64)
                total[np.frombuffer(slots.as_py(), "<u2")] += np.frombuffer(counts.as_py(), "<i8")
        if part is not None:
            yield give()

    counted = docs.select("text").mapInArrow(run, "part int, slots binary, counts binary").repartition(SLOTS // PART, "part").sortWithinPartitions("part")
    parts = counted.mapInArrow(add, "part int, levels binary").collect()  # SLOTS bytes
    out = np.zeros(SLOTS, np.uint8)
    for r in parts:
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["levels"], np.uint8)
    return out


def shingle_levels(words: np.ndarray, counts: np.ndarray, k: int, level: np.ndarray) -> np.ndarray:
    """A level from 0 (rare) to 63 for each shingle of the rows: the mean of its words' levels."""
    number = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.repeat(np.cumsum(counts) - counts - np.cumsum(number) + number, number) + np.arange(number.sum())
    width = np.repeat(np.minimum(counts, k), number)
    run = np.r_[0, np.cumsum(level[(words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], dtype=np.int64)]
    return ((run[first + width] - run[first]) // np.maximum(4 * width, 1)).astype(np.uint64)


def needed(nx, ny, num: int, den: int):
    """Least intersection of sets of these sizes with num / den of their union: ceil(num (nx + ny) / (num + den))."""
    return -(-num * (nx + ny) // (num + den))


def shared_least(n):
    """How many prefix shingles a set asks a partner to share; of two sets, the smaller number counts."""
    return 1 + n // 100


def prefix_length(n, num: int, den: int):
    return np.where(n > 0, np.minimum(n - -(-num * n // den) + shared_least(n), n), 0)


def parities(token: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(rows, WORDS) parity sketches of the rows' sets."""
    out = np.zeros((len(number), WORDS), np.uint64)
    if len(token):
        h = mix(token & np.uint64((1 << 58) - 1))
        word, bit = (h >> np.uint64(6)) % np.uint64(WORDS), np.uint64(1) << (h & np.uint64(63))
        full = np.flatnonzero(number > 0)
        start = (np.cumsum(number) - number)[full]
        for w in range(WORDS):
            out[full, w] = np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), start)
    return out


def classes_table(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, c1, c2, n, sketch): class, set size and parity sketch of every row of docs (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j in slices(b.column("text"), SLICE):
                h, number, words, counts = hashes_of(b.column("text").slice(i, j - i), k)
                c1, c2 = class_ids(words, counts)
                token, n = token_sets(h, number, None)
                sketch = parities(token, n).view(np.int64)
                cols = [pa.array(c1), pa.array(c2), pa.array(n), *[pa.array(np.ascontiguousarray(sketch[:, w])) for w in range(WORDS)]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *cols], ["doc_id", "c1", "c2", "n", *SKETCH])

    return docs.mapInArrow(run, "doc_id long, c1 long, c2 long, n long, " + ", ".join(f"{w} long" for w in SKETCH))


def prefixes(docs: DataFrame, k: int, num: int, den: int, level) -> DataFrame:
    """(token, c1, n, pos) of the prefixes; of equal rows at hand, the first stands for its class."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j in slices(b.column("text"), SLICE):
                h, number, words, counts = hashes_of(b.column("text").slice(i, j - i), k)
                c1, c2 = class_ids(words, counts)
                _, first = np.unique(np.stack([c1, c2], 1), axis=0, return_index=True)
                alone = np.zeros(len(c1), bool)
                alone[first] = True
                token, n = token_sets(h, number, shingle_levels(words, counts, k, level.value))
                start = np.cumsum(n) - n
                p = np.where(alone, prefix_length(n, num, den), 0)
                row = np.repeat(np.arange(len(n)), p)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(p) - p, p)
                cols = [token[start[row] + pos].view(np.int64), c1[row], n[row].astype(np.int32), pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "c1", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token long, c1 long, n int, pos int")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The prefix rows whose token several classes have, one for each class, with the bucket's first class (p1, pn, ppos).

    Rows come sorted within their partition, so a bucket of any size passes by in batches; only its first row is held.
    """

    def run(batches):
        import pyarrow as pa

        held = None  # the last row so far: (token, c1, n, pos), the bucket's first row, and whether it has been given out
        for b in batches:
            if not b.num_rows:
                continue
            token, c1, n, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "c1", "n", "pos"))
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (c1[1:] != c1[:-1])
            if held is not None and (token[0], c1[0]) == held[0][:2]:
                fresh[0] = False
            token, c1, n, pos = token[fresh], c1[fresh], n[fresh], pos[fresh]
            if not len(token):
                continue
            start = np.ones(len(token), bool)
            start[1:] = token[1:] != token[:-1]
            goes_on = held is not None and token[0] == held[0][0]
            start[0] = not goes_on
            at = np.maximum.accumulate(np.where(start, np.arange(len(token)), -1))
            p1, pn, pp = (np.where(at >= 0, x[np.maximum(at, 0)], held[1][k] if held else 0) for k, x in ((1, c1), (2, n), (3, pos)))
            more = np.zeros(len(token), bool)  # the bucket has another class
            more[:-1] = token[1:] == token[:-1]
            give = ~start
            give[:-1] |= more[:-1]
            cols = [token, c1, n, pos, p1, pn, pp]
            if goes_on and not held[2]:
                own = held[0]
                cols = [np.r_[np.array([v], x.dtype), x] for v, x in zip((*own, *held[1][1:]), cols)]
                give = np.r_[True, give]
            last = give[-1]
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[give]) for x in cols], ["token", "c1", "n", "pos", "p1", "pn", "ppos"])
            first = (cols[0][-1], cols[4][-1], cols[5][-1], cols[6][-1])
            held = (tuple(x[-1] for x in cols[:4]), first, bool(last))

    ordered = rows.select("token", "c1", "n", "pos").repartition("token").sortWithinPartitions("token", "n", "c1")
    return ordered.mapInArrow(run, "token long, c1 long, n int, pos int, p1 long, pn int, ppos int")


def dealt_buckets(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows with `cell`, `block` and `own`: each row of a large bucket (token, blocks) comes once for each pair of blocks that
    its block is in; pairs within a block count only in the cell of the block alone (`own`)."""
    x = rows.join(large, "token", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("class"), "blocks")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    cell = F.least("block", "other") * F.coalesce("blocks", F.lit(1)) + F.greatest("block", "other")
    return x.withColumn("cell", cell.cast("long")).withColumn("own", F.col("block") == F.col("other")).drop("blocks", "other")


def crossing_pairs(rows: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Distinct pairs (u, v) of rows (token, cell, block, own, comp, class, n, pos and the sketch) that share tokens enough,
    lie in different components and pass the length, positional and suffix filters; or for each row, its nearest such
    partner only, met twice.

    A shared token tells that at most the tokens before it in both sets, itself and those after it are common. Buckets pass
    by sorted by token, cell and size; the last of a batch waits for the next. Many small buckets are worked on at once, a
    large one in blocks; what is given out is distinct within some MB already.
    """

    def kept(x, i, j):
        ok = (x["comp"][i] != x["comp"][j]) & (x["own"][i] | (x["block"][i] != x["block"][j]))
        i, j = i[ok], j[ok]
        n, m = x["n"][i], x["n"][j]
        need = needed(n, m, num, den)
        p, q = x["pos"][i], x["pos"][j]
        ok = (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (np.minimum(p, q) + 1 + np.minimum(n - p - 1, m - q - 1) >= need)
        i, j, most = i[ok], j[ok], (n + m - 2 * need)[ok]
        apart = np.zeros(len(i), np.int64)
        for w in range(0, WORDS, 4):
            apart += np.bitwise_count(x["sketch"][i, w : w + 4] ^ x["sketch"][j, w : w + 4]).sum(1, dtype=np.int64)
            ok = apart <= most
            if not ok.all():
                i, j, most, apart = i[ok], j[ok], most[ok], apart[ok]
        return i, j, apart

    def counted(x, i, j):
        """u, v, how many shared shingles they need, and how many these are."""
        u, v = x["class"][i], x["class"][j]
        need = shared_least(np.minimum(x["n"][i], x["n"][j]))
        pair, times = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v), np.minimum(need, 2) if nearest else need]), axis=1, return_counts=True)
        return np.vstack([pair, times])

    def within(x, start, size):
        """Index pairs of buckets that begin at start, some 100,000 at once."""
        small = np.flatnonzero((size > 1) & (size <= 256))
        todo = size[small] * (size[small] - 1) // 2
        share = np.cumsum(todo) // (1 << 18)
        for g in np.split(small, np.flatnonzero(np.diff(share)) + 1) if len(small) else []:
            own = np.repeat(start[g], size[g]) + np.arange(size[g].sum()) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
            after = np.repeat(start[g] + size[g], size[g]) - own - 1
            i = np.repeat(own, after)
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        for g in np.flatnonzero(size > 256):
            a, z = start[g], start[g] + size[g]
            reach = a + np.searchsorted(x["n"][a:z], x["n"][a:z] * den // num, "right")  # sizes rise within a bucket
            for p in range(a, z, 256):
                q = min(p + 256, z)
                for c in range(p, int(reach[p - a : q - a].max()), 1024):
                    e = min(c + 1024, int(reach[p - a : q - a].max()))
                    i, j = np.nonzero(x["comp"][p:q, None] != x["comp"][None, c:e])
                    i, j = i + p, j + c
                    yield i[i < j], j[i < j]

    def solve(table):
        x = {c: table.column(c).to_numpy() for c in ("token", "cell", "block", "own", "comp", "class", "n", "pos")}
        x |= {c: x[c].astype(np.int64) for c in ("n", "pos")}
        x["sketch"] = np.stack([table.column(w).to_numpy() for w in SKETCH], 1).view(np.uint64)
        start = np.flatnonzero(np.r_[True, (x["token"][1:] != x["token"][:-1]) | (x["cell"][1:] != x["cell"][:-1])])
        size = np.diff(np.r_[start, len(x["token"])])
        best, partner = np.full(len(x["token"]), 1 << 30), np.full(len(x["token"]), -1)
        found = []
        for i, j in within(x, start, size):
            i, j, apart = kept(x, i, j)
            if not len(i):
                continue
            if nearest:
                for p, q in ((i, j), (j, i)):
                    order = np.lexsort((q, apart, p))
                    first = order[np.r_[True, p[order][1:] != p[order][:-1]]]
                    better = first[apart[first] < best[p[first]]]
                    best[p[better]], partner[p[better]] = apart[better], q[better]
            else:
                found.append(counted(x, i, j))
                if sum(f.shape[1] for f in found) > 1 << 18:
                    yield np.concatenate(found, 1)
                    found = []
        if nearest:
            i = np.flatnonzero(partner >= 0)
            found = [counted(x, i, partner[i])]
        if found:
            yield np.concatenate(found, 1)

    def run(batches):
        import pyarrow as pa

        def give(table):
            for block in solve(table.combine_chunks()):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in block], ["u", "v", "need", "times"])

        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size > 1 << 16:
                table = pa.Table.from_batches(held)
                token, cell = table.column("token").to_numpy(), table.column("cell").to_numpy()
                other = np.flatnonzero((token != token[-1]) | (cell != cell[-1]))
                if len(other):
                    yield from give(table.slice(0, int(other[-1]) + 1))
                    held = table.slice(int(other[-1]) + 1).to_batches()
                    size = sum(x.num_rows for x in held)
        if held:
            yield from give(pa.Table.from_batches(held))

    ordered = rows.select("token", "cell", "block", "own", "comp", "class", "n", "pos", *SKETCH).repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "class")
    met = ordered.mapInArrow(run, "u long, v long, need long, times long").groupBy("u", "v").agg(F.max("need").alias("need"), F.sum("times").alias("times"))
    return met.where("times >= need").select("u", "v")


def merged(comps: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """Components (node, component) after more links (u, v), and how many pairs of components these
    join: the components' own links are found and joined back."""
    a, b = (comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "uv")
    x = links.join(a, "u", "left").join(b, "v", "left").select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv"))
    x = materialize(x)
    crossing = x.where("cu <> cv").select(F.least("cu", "cv"), F.greatest("cu", "cv")).distinct().count()
    if not crossing:
        return comps, 0
    found = connected_components(x.where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    nodes = comps.union(x.select("u", "cu")).union(x.select("v", "cv")).distinct()
    up = found.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return materialize(nodes.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))), crossing


def maybe_wanted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs without most rows whose doc_id isn't wanted: a filter of FILTER bits, which lets a few others through."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    words = wanted.select(place.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS INT))")).alias("bits"))
    table = np.zeros(FILTER // 64, np.int64)
    found = words.toArrow()  # FILTER / 64 rows at most
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            p = b.column("place").to_numpy(zero_copy_only=False)
            ok = (shared.value[p // 64] >> (p % 64)) & 1 == 1
            yield b.filter(pa.array(ok)).select(["doc_id", "text"])

    return docs.withColumn("place", place).mapInArrow(run, "doc_id long, text string")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of classes whose shingle sets link, with `shared` and `joint` sizes; nodes (class, rep, c1) names a
    row of docs (doc_id, text) for each class, which is that of id rep whose text has the hash c1.

    The members of a hub u are dealt out in blocks; each block gets the hub's text first and streams its members by.
    Before sets are intersected, the suffix filter bounds the intersection by the smaller counts of both in 16 ranges of
    the hash.
    """
    blocks = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "u").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
    wanted = dealt.select(F.col("v").alias("class"), "u", "block", F.lit(True).alias("member"))
    wanted = wanted.union(dealt.select(F.col("u").alias("class"), "u", "block", F.lit(False)).distinct())
    wanted = wanted.join(nodes.select("class", "c1", F.col("rep").alias("doc_id")), "class")
    texts = maybe_wanted(docs, wanted.select("doc_id").distinct())
    rows = wanted.join(texts, "doc_id").select("u", "block", "member", "class", "c1", "text")
    rows = rows.repartition("u", "block").sortWithinPartitions("u", "block", "member", "class")

    def run(batches):
        import pyarrow as pa

        hub, own = None, None
        for whole in batches:
            for i, j in slices(whole.column("text"), SLICE):
                b = whole.slice(i, j - i)
                right = class_ids(*hashes_of(b.column("text"), 1)[2:])[0] == b.column("c1").to_numpy()
                b = b.filter(pa.array(right))  # ids that repeat bring other texts, too
                if not b.num_rows:
                    continue
                h, number, _, _ = hashes_of(b.column("text"), k)
                token, n = token_sets(h, number, None)
                stop = np.cumsum(n)
                us, member, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "member", "class"))
                out = []
                edges = np.flatnonzero(np.r_[True, (us[1:] != us[:-1]) | (member[1:] != member[:-1]), True])
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if not member[x]:
                        hub, own = us[x], token[stop[x] - n[x] : stop[x]]  # of equal texts, the first
                        bins = np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=16)
                        continue
                    assert us[x] == hub
                    block = token[stop[x] - n[x] : stop[y - 1]]
                    row = np.repeat(np.arange(y - x), n[x:y])
                    need = needed(len(own), n[x:y], num, den)
                    counts = np.bincount(row * 16 + (block >> np.uint64(54)).astype(np.int64), minlength=16 * (y - x)).reshape(-1, 16)
                    can = np.minimum(counts, bins).sum(1) >= need
                    live = can[row]
                    place = np.minimum(np.searchsorted(own, block[live]), max(len(own) - 1, 0))
                    same = own[place] == block[live] if len(own) else np.zeros(live.sum(), bool)
                    shared = np.bincount(row[live][same], minlength=y - x)
                    joint = len(own) + n[x:y] - shared
                    ok = can & (shared * den >= num * joint) & (joint > 0)
                    out.append((np.full(ok.sum(), hub), ids[x:y][ok], shared[ok], joint[ok]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["u", "v", "shared", "joint"])

    return rows.mapInArrow(run, "u long, v long, shared long, joint long")


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when their sets of k-word shingles have num / den of their union in common. component_id is the
    smallest id that links reach, the row's own included. With fewer than k words, the whole sequence is the one
    shingle; a text without words (or null) has an empty set and is its own component, unless another row has its id.
    Rows with one id are one node: their component is one, and each keeps its own n_shingles. A null id counts as the
    smallest, and comes back as null; so rows with null ids are one node.
    """
    x = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    known = materialize(classes_table(x, k))
    reps = known.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), *[F.min(w).alias(w) for w in SKETCH])
    nodes = materialize(reps.withColumn("class", F.monotonically_increasing_id()))  # the checkpoint fixes the numbers
    level = spark.sparkContext.broadcast(count_levels(x))  # SLOTS bytes
    shared, path = store(shared_buckets(prefixes(x, k, num, den, level)))
    large = shared.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BUCKET)
    large = materialize(large.select("token", F.ceil(F.col("rows") / BUCKET).cast("int").alias("blocks")))
    # First pairs: every class of a bucket with the bucket's first, whose set is the smallest; filtered as below.
    a, b = F.col("pn").cast("long"), F.col("n").cast("long")
    need = F.ceil(F.lit(num) * (a + b) / F.lit(num + den))
    room = F.least("ppos", "pos") + 1 + F.least(a - F.col("ppos") - 1, b - F.col("pos") - 1)
    stars = shared.where((F.col("c1") != F.col("p1")) & (a * den >= b * num) & (room >= need))
    stars = stars.groupBy("c1", "p1", "n", "pn").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= F.floor(a / 100) + 1)
    one = nodes.select(F.col("c1").alias("p1"), F.col("class").alias("u"), *[F.col(w).alias(f"u{w}") for w in SKETCH])
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"u{w}"))) for w in SKETCH), F.lit(0))
    stars = stars.join(nodes, "c1").join(one, "p1").where(apart <= a + b - 2 * need)
    tried = materialize(stars.select(F.least("u", "class").alias("u"), F.greatest("u", "class").alias("v")).where("u <> v").distinct())
    links = verified(tried, nodes, x, k, num, den).select("u", "v")
    # Classes that share an id are linked as well.
    ids = known.join(nodes.select("c1", "c2", "class"), ["c1", "c2"]).select("doc_id", "class")
    first = ids.groupBy("doc_id").agg(F.min("class").alias("u"), F.max("class").alias("last")).where("u < last")
    links = links.union(ids.join(first, "doc_id").select("u", F.col("class").alias("v")).where("u <> v").distinct())
    comps, _ = merged(nodes.select(F.col("class").alias("node"), F.col("class").alias("component")).limit(0), links)
    free_shuffles(spark)
    nearest = True
    while True:
        own = shared.select("token", "c1", "n", "pos").join(nodes.select("c1", "class", *SKETCH), "c1").join(comps.withColumnRenamed("node", "class"), "class", "left")
        own = dealt_buckets(own.withColumn("comp", F.coalesce("component", "class")), large)
        pairs = materialize(crossing_pairs(own, num, den, nearest).join(tried, ["u", "v"], "left_anti"))
        found, crossing = pairs.count(), 0
        if found:
            comps, crossing = merged(comps, verified(pairs, nodes, x, k, num, den).select("u", "v"))
        if not nearest:
            break
        tried = materialize(tried.union(pairs))
        nearest = 0 < found <= 2 * crossing
        free_shuffles(spark)
    discard(spark, path)
    # The least id of each component, over all rows of its classes, and of each id over its rows.
    tops = nodes.select("c1", "c2", "class", "rep").join(comps.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    tops = tops.join(tops.groupBy("component").agg(F.min("rep").alias("top")), "component").select("c1", "c2", "top")
    full = known.select("doc_id", "c1", "c2", "n").join(tops, ["c1", "c2"], "left")
    by_id = full.groupBy("doc_id").agg(F.min("top").alias("top"))
    full = full.select("doc_id", "n").join(by_id, "doc_id")
    back = lambda c: F.when(c != LOW, c)
    return full.select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("top", "doc_id")).alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of docs whose id is the component_id of near_components(): one of each group, that with the smallest id."""
    kept = near_components(docs, id_col=id_col, **kw).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]), "left_semi")


QUERY_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingles
  FROM w),
t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS shared
      FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY ALL),
l AS (SELECT u, v FROM p WHERE 100 * shared >= 90 * (nu + nv - shared)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
c AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT c.doc_id, e.v FROM c JOIN e ON c.r = e.u)
SELECT s.doc_id, len(any_value(s.shingles))::BIGINT AS n_shingles, min(c.r) AS component_id FROM s JOIN c ON s.doc_id = c.doc_id GROUP BY s.doc_id
"""
