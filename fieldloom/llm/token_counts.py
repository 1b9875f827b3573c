"""Token counts: the exact histogram of encoded lengths, and its suffix sums."""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_buffer, word_hashes

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual pre-token pattern of this family of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are worked on at once.
SLICE = 4 << 20
#: First bytes of UTF-8 sequences that may be white space beyond ASCII.
_MAYBE_SPACE = (0xC2, 0xE1, 0xE2, 0xE3)


def load_encoder(path: str = RANKS, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where rows may be cut without changing their pre-tokens: before a space that no white space follows.

    A pre-token never has a space after its first character, except runs of white space, and such a run gives its last
    space to what follows. Bytes that may begin other white space are left uncut.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        after = data[1:]
        stop = (after == 32) | ((after >= 9) & (after <= 13))
        for b in _MAYBE_SPACE:
            stop |= after == b
        cut[: n - 1] = (data[:-1] == 32) & ~stop
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut[:n])


def distinct_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of a representative of each distinct chunk, and each chunk's place among them; compared byte by byte."""
    hashes = word_hashes(data, starts, ends, False)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    length = ends - starts
    rep = first[inverse]
    same = length == length[rep]
    if same.all() and len(length):
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        differ = data[np.repeat(starts, length) + at] != data[np.repeat(starts[rep], length) + at]
        same = np.bincount(np.repeat(np.arange(len(length)), length)[differ], minlength=len(length)) == 0
    if not same.all():  # a collision of hashes: those chunks stand for themselves
        odd = np.flatnonzero(~same)
        inverse = inverse.copy()
        inverse[odd] = len(first) + np.arange(len(odd))
        first = np.r_[first, odd]
    return first, inverse


def count_batch(encoder, column) -> np.ndarray:
    """Encoded length of each row of an Arrow string column; each distinct chunk of some MB is encoded once."""
    parts = [count_slice(encoder, column.slice(i, j - i)) for i, j in slices(column, SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def count_slice(encoder, column) -> np.ndarray:
    data, offsets = text_buffer(column)
    starts = chunk_starts(data, offsets)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    ends = np.r_[starts[1:], len(data)]
    first, inverse = distinct_chunks(data, starts, ends)
    raw = data.tobytes()
    encode = encoder.encode_ordinary
    lengths = np.fromiter((len(encode(raw[a:b].decode())) for a, b in zip(starts[first].tolist(), ends[first].tolist())), np.int64, len(first))
    running = np.r_[0, np.cumsum(lengths[inverse])]
    return np.diff(running[np.searchsorted(starts, offsets)])


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every row; null and empty texts have 0 tokens. Special tokens' strings are ordinary text."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        encoder = load_encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count_batch(encoder, b.column("text")))], ["doc_id", "n_tokens"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")


def length_histogram(lengths: DataFrame, bucket: int = 1024) -> DataFrame:
    """One row for each length that occurs: n_tokens, n_docs, docs_from, tokens_from, truncated_total, total_tokens, share_up_to.

    docs_from and tokens_from are suffix sums: documents of at least this length, and their tokens. truncated_total is
    what remains when every document is cut at this length; for a limit between two lengths, take the next larger
    length's row and subtract docs_from for each token less. share_up_to is the share of documents at most as long.
    Suffix sums are formed within buckets of lengths and over the buckets' totals. An empty table has no rows.
    """
    h = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("bucket", F.floor(F.col("n_tokens") / bucket))
    h = h.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = h.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row for `bucket` lengths
    every = Window.partitionBy()
    totals = totals.select(
        "bucket", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc())
    out = h.join(totals, "bucket")
    out = out.withColumn("docs_from", F.col("d_after") + F.sum("n_docs").over(within)).withColumn("tokens_from", F.col("t_after") + F.sum("tokens").over(within))
    return out.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", (F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        "total_tokens", ((F.col("d_all") - F.col("docs_from") + F.col("n_docs")) / F.col("d_all")).alias("share_up_to"),
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least `share` of the documents do not exceed."""
    return histogram.where(F.col("share_up_to") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens that remain when every document is cut at `limit`."""
    above = F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "truncated_total", "docs_from")))
    x = histogram.agg(above.alias("a"), F.max("total_tokens").alias("all"))
    cut = F.col("a.truncated_total") - (F.col("a.n_tokens") - limit) * F.col("a.docs_from")
    return x.select(F.coalesce(cut, F.col("all"), F.lit(0)).alias("truncated_total"))
