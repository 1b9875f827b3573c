"""Document fingerprints by a randomised edit embedding: shared random walks over characters, sampled at fixed steps.

A walk reads a text's characters; after each step a coin that depends on the step and the character decides whether it
moves on. Texts that differ by few edits soon walk in step again, so their embeddings differ in few places. A fingerprint
samples the embedding at the same steps for all texts of like length, so likeness is a Hamming similarity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, slices, text_buffer
from .components import connected_components

SAMPLES = 128
HEX = np.frombuffer(b"0123456789abcdef-", np.uint8)
PAD = 16
#: With so few walks left, they are finished one by one.
FEW = 48
#: Steps of a walk for which coins are drawn at once.
COINS = 1 << 16
#: Buckets of neighbouring ids for each partition.
BUCKETS = 4


def scale_of(n: np.ndarray) -> np.ndarray:
    """floor(log2(n)), 0 for the empty text."""
    return np.where(n > 0, np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1, 0).astype(np.int64)


def sample_steps(scale: int) -> np.ndarray:
    """The steps that fingerprints of a scale sample: a walk over n characters takes about 2 n steps."""
    return np.sort(np.random.default_rng(7919 + scale).integers(0, 2 << (scale + 1), SAMPLES))


def coins(first: int, n: int) -> np.ndarray:
    """64 coins for each step, one for each class of characters."""
    return mix(np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(12345))


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A class (0 to 63) of each code point of UTF-8 bytes, and its first byte's place."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    out = np.empty(len(at), np.uint8)
    for a in range(0, len(at), 1 << 20):  # in parts, so that a long text takes little memory
        own = at[a : a + (1 << 20)]
        value = data[own].astype(np.uint64)
        last = at[a + len(own)] if a + len(own) < len(at) else len(data)
        if len(own) < last - own[0]:
            width = np.diff(np.r_[own, last])
            for k in range(1, 4):
                more = np.flatnonzero(width > k)
                value[more] = value[more] * np.uint64(257) + data[own[more] + k]
        out[a : a + len(own)] = mix(value) >> np.uint64(58)
    return out, at


def walk(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, few: int = FEW) -> np.ndarray:
    """Symbols (n, 2, SAMPLES) sampled from the walks over code[starts:ends]: at the text's scale and at the next smaller."""
    n = len(starts)
    size = ends - starts
    scale = scale_of(size)
    out = np.full((n, 2, SAMPLES), PAD, np.uint8)
    if not n or not size.max():
        return out
    steps = {s: sample_steps(s) for s in range(int(scale.max()) + 1)}
    events: dict[int, list] = {}
    for s, places in steps.items():
        for k, j in enumerate(places.tolist()):
            events.setdefault(j, []).append((s, k))
    lanes = np.flatnonzero(size > 0)
    lanes = lanes[np.argsort(scale[lanes], kind="stable")]
    at, end, own = starts[lanes].copy(), ends[lanes], scale[lanes]
    symbol = (mix(np.arange(64, dtype=np.uint64) + np.uint64(99)) >> np.uint64(60)).astype(np.uint8)
    padded = np.r_[code, np.zeros(128, np.uint8)]
    step, block = 0, 64
    while len(lanes) > few:
        words = coins(step, block)
        table = ((words[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        for j in range(block):
            here = padded[at]
            for s, k in events.get(step + j, ()):
                lo, hi = np.searchsorted(own, (s, s + 1))
                if hi > lo:
                    out[lanes[lo:hi], 0, k] = np.where(at[lo:hi] < end[lo:hi], symbol[here[lo:hi]], PAD)
                lo, hi = np.searchsorted(own, (s + 1, s + 2))
                if hi > lo:
                    out[lanes[lo:hi], 1, k] = np.where(at[lo:hi] < end[lo:hi], symbol[here[lo:hi]], PAD)
            at += table[j][here]
        step += block
        live = at < end
        lanes, at, end, own = lanes[live], at[live], end[live], own[live]
    # The last few go on one by one, all through one block of coins before the next is drawn.
    rest = []
    for lane, p, e, s in zip(lanes.tolist(), at.tolist(), end.tolist(), own.tolist()):
        marks = [(m, 0, k) for k, m in enumerate(steps[s].tolist()) if m >= step]
        if s:
            marks += [(m, 1, k) for k, m in enumerate(steps[s - 1].tolist()) if m >= step]
        rest.append([lane, code[p:e].tobytes(), 0, sorted(marks, reverse=True)])
    while rest:
        words, stop = coins(step, COINS).tolist(), step + COINS
        for one in rest:
            lane, text, p, marks = one
            j, size = step, len(text)
            while marks:
                to = min(marks[-1][0], stop)
                while j < to and p < size:
                    p += (words[j - step] >> text[p]) & 1
                    j += 1
                if p >= size or j < marks[-1][0] or j >= stop:
                    break
                _, which, k = marks.pop()
                out[lane, which, k] = symbol[text[p]]
            one[2] = p
        rest = [one for one in rest if one[3] and one[2] < len(one[1])]
        step = stop
    return out


def as_text(scale: np.ndarray, symbols: np.ndarray) -> list[str]:
    """Fingerprints: two digits of scale, the symbols of that scale, then those of the next smaller; '-' past the end."""
    letters = HEX[symbols.reshape(len(symbols), -1)]
    return [f"{s:02d}{row.tobytes().decode()}" for s, row in zip(scale.tolist(), letters)]


def likeness(s: np.ndarray, a: np.ndarray, t: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal symbols at the scale that both have, where either text goes on; 1 for two empty texts, 0 for
    lengths too far apart."""
    x = np.where((s <= t)[:, None], a[:, 0], a[:, 1])
    y = np.where((t <= s)[:, None], b[:, 0], b[:, 1])
    there = (x != PAD) | (y != PAD)
    number = there.sum(1)
    equal = ((x == y) & there).sum(1)
    near = np.where(number > 0, equal / np.maximum(number, 1), (a == PAD).all((1, 2)) & (b == PAD).all((1, 2)))
    return np.where(np.abs(s - t) <= 1, near, 0.0).astype(np.float64)


def fingerprint_batch(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of code points, scale and symbols of each row."""
    data, offsets = text_buffer(column)
    code, at = classes(data)
    bounds = np.searchsorted(at, offsets)
    n = np.diff(bounds)
    return n, scale_of(n), walk(code, bounds[:-1], bounds[1:])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every whole text; null counts as empty."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j in slices(b.column("text"), 6 << 20):
                n, scale, symbols = fingerprint_batch(b.column("text").slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(as_text(scale, symbols), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, n_chars bigint, fingerprint string")


def likeness_column(a: Column, b: Column) -> Column:
    """likeness() of two fingerprint strings, as an expression."""
    s, t = F.substring(a, 1, 2), F.substring(b, 1, 2)
    x = F.when(s <= t, F.substring(a, 3, SAMPLES)).otherwise(F.substring(a, 3 + SAMPLES, SAMPLES))
    y = F.when(t <= s, F.substring(b, 3, SAMPLES)).otherwise(F.substring(b, 3 + SAMPLES, SAMPLES))
    pairs = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when((p == "-") & (q == "-"), F.lit(None)).otherwise((p == q).cast("int")))
    known = F.filter(pairs, lambda v: v.isNotNull())
    share = F.aggregate(known, F.lit(0), lambda acc, v: acc + v) / F.size(known)
    return F.when(a == b, F.lit(1.0)).when(F.abs(s.cast("int") - t.cast("int")) > 1, F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def near_links(prints: DataFrame, bands: int = 16, width: int = 8, least: float = 0.8, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (doc_id, with_id, likeness) between documents that agree in a band and are `least` alike: as many as join
    all that any such pairs would join, not all pairs.

    A band is `width` sampled symbols of one scale. Both scales of a fingerprint are banded, so lengths on either side
    of a power of two meet. Empty texts link with nothing. Likeness is that of the fingerprints or, with docs, of the
    texts: 1 - edit distance / longer length, for every candidate.

    The members of each band's bucket are ranked by a hash of their ids. Rounds hold the next 1, 2, 4 ... of them against
    all after them, but for pairs that links already join, until no bucket has such a pair left. A group of near copies
    is joined once one of it comes up; unlike documents that share a band are compared each with each.
    """
    scale = F.substring("fingerprint", 1, 2).cast("int")
    parts = [(scale - w, F.substring("fingerprint", 3 + w * SAMPLES + i * width, width), F.lit(i)) for w in (0, 1) for i in range(bands)]
    key = F.explode(F.array(*[F.struct(s.alias("scale"), p.alias("part"), i.alias("band")) for s, p, i in parts]))
    prints = materialize(prints.where("n_chars > 0").select("doc_id", "n_chars", "fingerprint"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("doc_id"), "doc_id")
    keyed = prints.select("doc_id", key.alias("key")).where(~F.contains("key.part", F.lit("-" * width)))
    members = materialize(keyed.withColumn("rank", F.row_number().over(order)))
    a = prints.select("doc_id", F.col("n_chars").alias("n"), F.col("fingerprint").alias("a"))
    b = prints.select(F.col("doc_id").alias("with_id"), F.col("n_chars").alias("m"), F.col("fingerprint").alias("b"))
    links = tried = prints.select("doc_id", F.col("doc_id").alias("with_id"), F.lit(1.0).alias("likeness")).where(F.lit(False))
    component, first = prints.select("doc_id", F.col("doc_id").alias("component")), 1
    while True:
        x = members.where(F.col("rank") >= first).join(component, "doc_id")
        several = x.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        x = materialize(x.join(several.select("key"), "key", "left_semi"))
        if x.isEmpty():
            return links
        now = x.where(F.col("rank") < 2 * first)
        pairs = now.alias("p").join(x.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.rank") < F.col("q.rank")) & (F.col("p.component") != F.col("q.component")))
        pairs = pairs.select(F.greatest("p.doc_id", "q.doc_id").alias("doc_id"), F.least("p.doc_id", "q.doc_id").alias("with_id")).distinct().join(tried, ["doc_id", "with_id"], "left_anti")
        pairs = pairs.join(a, "doc_id").join(b, "with_id")
        if docs is None:
            found = pairs.withColumn("likeness", likeness_column(F.col("a"), F.col("b")))
        else:
            found = text_likeness(pairs, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), least)
        found = materialize(found.select("doc_id", "with_id", "likeness"))
        tried = materialize(tried.union(found))
        links = tried.where(F.col("likeness") >= least)
        if not found.where(F.col("likeness") >= least).isEmpty():
            joined = connected_components(links.select(F.col("doc_id").alias("u"), F.col("with_id").alias("v"))).withColumnRenamed("node", "doc_id")
            component = materialize(prints.select("doc_id").join(joined, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
        first *= 2


def text_likeness(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (doc_id, with_id, n, m) with likeness: 1 - edit distance in code points / longer length, or 0 below `least`."""
    longer = F.greatest("n", "m")
    most = F.floor(longer * (1 - least) + 1e-9).cast("int")
    x = pairs.join(texts.withColumnRenamed("text", "s"), "doc_id").join(texts.select(F.col("doc_id").alias("with_id"), F.col("text").alias("t")), "with_id")
    x = x.withColumn("most", most).withColumn("edits", F.expr("levenshtein(s, t, most)"))
    # the division that decides is the one of whole numbers above
    return x.withColumn("likeness", F.when(F.col("edits") < 0, F.lit(0.0)).otherwise(F.greatest(1 - F.col("edits") / longer, F.lit(float(least)))))


def _bounds(docs: DataFrame, buckets: int) -> list[int]:
    """At most `buckets` - 1 ids that split the rows about evenly."""
    if buckets < 2:
        return []
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    got = docs.agg(F.percentile_approx("doc_id", shares, F.lit(10 * buckets))).first()[0]
    return sorted(set(got or []))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, copy, doc_id, text) in which each row's successor by id follows it within its bucket.

    Ids are cut into ranges; the first row of each range is copied to the end of the range before it, and the first of
    all to the end of the last. The driver holds one id for each range.
    """
    x = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(_bounds(x.select("doc_id"), parts * BUCKETS), np.int64)

    def place(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.searchsorted(bounds, b.column("doc_id").to_numpy(zero_copy_only=False)))], ["doc_id", "bucket"])

    least = {r["bucket"]: r["id"] for r in x.select("doc_id").mapInArrow(place, "doc_id long, bucket long").groupBy("bucket").agg(F.min("doc_id").alias("id")).collect()}
    there = sorted(least)
    before = {b: there[k - 1] for k, b in enumerate(there)}

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(bounds, ids)
            first = [i for i, (d, k) in enumerate(zip(ids.tolist(), bucket.tolist())) if least[k] == d]
            take = np.r_[np.arange(len(ids)), np.array(first, np.int64)].astype(np.int64)
            to = np.r_[bucket, np.array([before[bucket[i]] for i in first], np.int64)].astype(np.int64)
            copy = np.arange(len(take)) >= len(ids)
            own = b.take(pa.array(take)) if first else b
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(copy), own.column("doc_id"), own.column("text")], ["bucket", "copy", "doc_id", "text"])

    dealt = x.mapInArrow(deal, "bucket long, copy boolean, doc_id long, text string")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "copy", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the row's with its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next row's, by ascending id; after the last comes the first. Null text counts as empty. Rows that share an id
    follow one another by text, null first. A null id comes before all others. A table of one row is its own successor.
    """
    import hashlib

    def run(batches):
        import pyarrow as pa

        def done(rows):
            """Output for all of rows but the last, whose successor hasn't come."""
            column = pa.array([r[3] for r in rows], pa.large_binary())
            data, offsets = text_buffer(column)
            code, at = classes(data)
            bounds = np.searchsorted(at, offsets)
            at = np.r_[at, len(data)]
            n = np.diff(bounds)
            m = len(rows) - 1
            cut = n[:m] // 4
            given = np.minimum(cut, n[1:])
            sha, pieces = [], []
            for i in range(m):
                a, b = bounds[i], bounds[i + 1] - cut[i]
                c, d = bounds[i + 1], bounds[i + 1] + given[i]
                sha.append(hashlib.sha256(data[at[a] : at[b]].tobytes() + data[at[c] : at[d]].tobytes()).hexdigest())
                pieces += [code[a:b], code[c:d]]
            length = n[:m] - cut + given
            stop = np.cumsum(length)
            scale, symbols = scale_of(n), walk(code, bounds[:-1], bounds[1:])
            other, edited = scale_of(length), walk(np.concatenate(pieces), stop - length, stop)
            keep = [i for i in range(m) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            own, text, again = as_text(scale[:m], symbols[:m]), likeness(scale[:m], symbols[:m], other, edited), as_text(other, edited)
            near = likeness(scale[:m], symbols[:m], scale[1:], symbols[1:])
            pick = lambda x: [x[i] for i in keep]
            ids = [None if rows[i][2] == -(2**63) else rows[i][2] for i in keep]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pick(n.tolist()), pa.int64()), pa.array(pick(sha), pa.string()), pa.array(pick(own), pa.string()), pa.array(pick(again), pa.string()),
                 pa.array(pick(text.tolist()), pa.float64()), pa.array(pick(near.tolist()), pa.float64())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        held, size = [], 0
        for b in batches:
            for bucket, copy, doc_id, text in zip(*[b.column(k).to_pylist() for k in range(3)], b.column(3).cast(pa.binary())):
                raw = text.as_py() or b""
                if held and copy and held[-1][0] == bucket and held[-1][1]:
                    continue  # one copy is enough
                held.append((bucket, copy, doc_id, raw))
                size += len(raw)
                if size > 6 << 20 and len(held) > 1:
                    yield done(held)
                    held, size = held[-1:], len(raw)
        if len(held) > 1:
            yield done(held)

    return with_next(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
