"""SentencePiece unigram encoding by Viterbi over a double-array trie of pieces, with byte fallback, and decoding."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer
from .token_counts import distinct_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text worked on at once.
SLICE = 1 << 20
#: An unknown character scores this much below the least piece (fixed by the format).
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message; nested messages are bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind in (1, 5):
            width = 8 if kind == 1 else 4
            value, at = raw[at : at + width], at + width
        else:
            n = varint()
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


@dataclass(frozen=True)
class Model:
    """Pieces with scores and kinds, and their trie; the mark of white space is the byte of a space throughout."""

    pieces: list
    scores: np.ndarray
    kinds: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece of a node, or -1
    byte_ids: np.ndarray
    dummy_prefix: bool
    cut_newlines: bool
    unknown: int


def build_trie(items: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A double array: child of node s by byte b is base[s] + b if check[] there is s; value[] has what a node accepts."""
    tree = [{}]
    accept = [-1]
    for word, k in items:
        s = 0
        for b in word:
            if b not in tree[s]:
                tree[s][b] = len(tree)
                tree.append({})
                accept.append(-1)
            s = tree[s][b]
        accept[s] = k
    size = 2 * len(tree) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    check[0] = 0
    low = front = 257  # from here on a base is positive whatever the byte
    queue, top = [(0, 0)], 0
    for node, slot in queue:
        value[slot] = accept[node]
        if not (kids := tree[node]):
            continue
        order = sorted(kids)
        while taken[low]:
            low += 1
        if len(order) == 1:  # any free place does
            b = low - order[0]
        else:
            begin = b = front - order[0]
            while any(taken[b + c] for c in order):
                b += 1
            if b - begin > 64:  # that stretch is nearly full
                front = b + order[0]
        if b + 256 >= len(taken):
            more = len(taken)
            taken += bytearray(more)
            base, check, value = np.r_[base, np.zeros(more, np.int32)], np.r_[check, np.full(more, -1, np.int32)], np.r_[value, np.full(more, -1, np.int32)]
        base[slot] = b
        for c in order:
            taken[b + c] = 1
            check[b + c] = slot
            queue.append((kids[c], b + c))
            top = max(top, b + c)
    end = top + 257  # any byte from any node stays inside
    out = []
    for a, fill in ((base, 0), (check, -1), (value, -1)):
        out.append(np.r_[a[: top + 1], np.full(end - top - 1, fill, np.int32)])
    return tuple(out)


def parse_model(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, kinds, dummy = [], [], [], True
    for number, value in _fields(raw):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            pieces.append(piece[1])
            scores.append(struct.unpack("<f", piece[2])[0])
            kinds.append(piece[3])
        elif number == 3:
            spec = dict(_fields(value))
            dummy = bool(spec.get(3, 1))
            if spec.get(2):
                raise ValueError("models that rewrite characters are not supported")
            if spec.get(4, 1):
                raise ValueError("models that remove white space are not supported")
    kinds, scores = np.array(kinds), np.array(scores, np.float64)
    plain = [p.replace(MARK.encode(), b" ") if k != BYTE else bytes([int(p[3:5], 16)]) for p, k in zip(pieces, kinds)]
    used = [k for k in range(len(plain)) if kinds[k] in (NORMAL, USER) and plain[k]]
    for k in used:
        if b" " in plain[k].lstrip(b" "):
            raise ValueError("pieces with white space after other characters are not supported")
    user = kinds == USER
    scores[user] = [len(pieces[k].decode()) * scores[kinds == NORMAL].max() - 0.1 for k in np.flatnonzero(user)]
    base, check, value = build_trie([(plain[k], k) for k in used])
    byte_ids = np.full(256, -1, np.int32)
    for k in np.flatnonzero(kinds == BYTE):
        byte_ids[plain[k][0]] = k
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    cut = not any(b"\n" in plain[k] and len(plain[k]) > 1 for k in used)
    return Model(plain, scores, kinds, base, check, value, byte_ids, dummy, cut, int(np.flatnonzero(kinds == UNKNOWN)[0]))


def _floor(m: Model) -> float:
    return float(m.scores[m.kinds == NORMAL].min()) - UNKNOWN_PENALTY


def viterbi_one(m: Model, text: bytes) -> tuple[list[int], list[int], list[int]]:
    """Starts, ends and pieces (-1: unknown) of the best path of one chunk of any length."""
    n = len(text)
    base, check, value, scores, least = m.base, m.check, m.value, m.scores, _floor(m)
    best, back, piece = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for p in range(n):
        if best[p] is None or 128 <= text[p] < 192:
            continue
        wide = 1
        while p + wide < n and 128 <= text[p + wide] < 192:
            wide += 1
        s, single = 0, False
        for q in range(p, n):
            t = int(base[s]) + text[q]
            if check[t] != s or t == s:
                break
            s = t
            if (k := int(value[s])) >= 0:
                single |= q + 1 - p == wide
                score = best[p] + scores[k]
                if best[q + 1] is None or score > best[q + 1]:
                    best[q + 1], back[q + 1], piece[q + 1] = score, p, k
        if not single:
            score = best[p] + least
            if best[p + wide] is None or score > best[p + wide]:
                best[p + wide], back[p + wide], piece[p + wide] = score, p, -1
    out = []
    at = n
    while at:
        out.append((back[at], at, piece[at]))
        at = back[at]
    return tuple(map(list, zip(*out[::-1]))) if out else ([], [], [])


def viterbi_many(m: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all chunks, one after another, and their number in each chunk. All chunks advance in step.

    Position by position, every chunk that has a character there walks the trie; of equal scores the longest piece,
    which begins first, stays. Chunks longer than `long` bytes are solved one by one.
    """
    length = ends - starts
    count = len(length)
    order = np.argsort(-length, kind="stable")
    many = int(np.searchsorted(-length[order], -long))  # chunks before it are longer than long
    span_of, span_s, span_e, span_k, span_t = [], [], [], [], []
    for c in order[:many]:
        a, b, k = viterbi_one(m, data[starts[c] : ends[c]].tobytes())
        span_of.append(np.full(len(a), c))
        span_s.append(np.array(a, np.int64) + starts[c])
        span_e.append(np.array(b, np.int64) + starts[c])
        span_k.append(np.array(k, np.int64))
        span_t.append(-np.array(b, np.int64))
    idx = order[many:]
    if len(idx):
        ln, st = length[idx], starts[idx]
        slot = np.r_[0, np.cumsum(ln + 1)][:-1]
        best = np.full(int((ln + 1).sum()), -np.inf)
        best[slot] = 0.0
        back, piece = np.zeros(len(best), np.int32), np.full(len(best), -1, np.int32)
        least = _floor(m)
        base, check, value, scores = m.base, m.check, m.value, m.scores
        for p in range(int(ln[0])):
            live = np.arange(int(np.searchsorted(-ln, -p)))  # lengths above p
            byte = data[st[live] + p]
            live = live[(byte < 128) | (byte >= 192)]
            if not len(live):
                continue
            here = best[slot[live] + p]
            first = data[st[live] + p]
            wide = 1 + (first >= 192).astype(np.int64) + (first >= 224) + (first >= 240)
            single = np.zeros(len(live), bool)
            walk, state, depth = np.arange(len(live)), np.zeros(len(live), np.int64), 0
            while len(walk):
                c = live[walk]
                t = base[state] + data[st[c] + p + depth]
                ok = (check[t] == state) & (t != state)
                walk, state, c = walk[ok], t[ok], c[ok]
                depth += 1
                k = value[state]
                hit = np.flatnonzero(k >= 0)
                if len(hit):
                    w, kk, to = walk[hit], k[hit], slot[c[hit]] + p + depth
                    single[w] |= wide[w] == depth
                    score = here[w] + scores[kk]
                    win = score > best[to]
                    best[to[win]], back[to[win]], piece[to[win]] = score[win], p, kk[win]
                more = ln[c] > p + depth
                walk, state = walk[more], state[more]
            lone = np.flatnonzero(~single)
            if len(lone):
                c = live[lone]
                to = slot[c] + p + wide[lone]
                score = here[lone] + least
                win = score > best[to]
                best[to[win]], back[to[win]], piece[to[win]] = score[win], p, -1
        at, own = ln.copy(), np.arange(len(idx))
        while len(own):
            j = slot[own] + at
            span_of.append(idx[own])
            span_s.append(st[own] + back[j])
            span_e.append(st[own] + at)
            span_k.append(piece[j].astype(np.int64))
            span_t.append(-at)
            at = back[j].astype(np.int64)
            own, at = own[at > 0], at[at > 0]
    if not span_of:
        return np.zeros(0, np.int32), np.zeros(count, np.int64)
    of, s, e, k, t = map(np.concatenate, (span_of, span_s, span_e, span_k, span_t))
    by = np.lexsort((-t, of))
    of, s, e, k = of[by], s[by], e[by], k[by]
    n = np.where(k < 0, e - s, 1)
    ids = np.repeat(k, n).astype(np.int32)
    unknown = ids < 0
    if unknown.any():
        place = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(len(ids))
        ids[unknown] = m.byte_ids[data[place[unknown]]]
    return ids, np.bincount(of, weights=n, minlength=count).astype(np.int64)


def encode_batch(m: Model, column) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows, one after another, and row offsets. Each distinct chunk between white space is solved once."""
    import pyarrow.compute as pc

    data, offsets = text_buffer(pc.replace_substring(column, MARK, " "))
    rows = len(offsets) - 1
    if m.dummy_prefix:
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.r_[0, np.cumsum(full)]
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    cut = np.zeros(n, bool)
    cut[1:] = (data[1:] == 32) & (data[:-1] != 32)
    if m.cut_newlines:
        line = data == 10
        cut |= line
        cut[1:] |= line[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.r_[starts[1:], n]
    first, inverse = distinct_chunks(data, starts, ends)
    ids, number = viterbi_many(m, data, starts[first], ends[first])
    begin = np.cumsum(number) - number
    each = number[inverse]
    at = np.repeat(begin[inverse] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    running = np.r_[0, np.cumsum(each)]
    return ids[at], running[np.searchsorted(starts, offsets)]


def decode_batch(m: Model, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """UTF-8 of each row: pieces joined, marks as spaces, byte pieces as bytes (what isn't UTF-8 becomes U+FFFD), the
    space that encoding puts first removed. Control pieces are empty; an unknown piece is ' ⁇ '."""
    table = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p for p, k in zip(m.pieces, m.kinds)]
    lens = np.array([len(p) for p in table], np.int64)
    flat = np.frombuffer(b"".join(table) or b"\0", np.uint8)
    begin = np.cumsum(lens) - lens
    each = lens[ids]
    at = np.repeat(begin[ids] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    raw = flat[at].tobytes() if len(ids) else b""
    running = np.r_[0, np.cumsum(each)][offsets]
    out = []
    for a, b in zip(running[:-1].tolist(), running[1:].tolist()):
        if m.dummy_prefix and raw[a : a + 1] == b" ":
            a += 1
        piece = raw[a:b]
        try:
            piece.decode()
        except UnicodeDecodeError:
            piece = piece.decode(errors="replace").encode()
        out.append(piece)
    return out


def sliced(batches, text: str):
    for b in batches:
        for i, j in slices(b.column(text), SLICE):
            yield b.slice(i, j - i)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have no ids. A text's own marks count as spaces."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(parse_model(path))  # as large as the vocabulary

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches, "text"):
            ids, offsets = encode_batch(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give empty text."""
    x = tokens.select("doc_id", F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"))
    shared = tokens.sparkSession.sparkContext.broadcast(parse_model(path))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists = b.column("ids")
            offsets = np.asarray(lists.offsets, np.int64)
            ids = np.asarray(lists.values)[offsets[0] : offsets[-1]]
            out = decode_batch(shared.value, ids, offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([o.decode() for o in out], pa.string())], ["doc_id", "text"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, text string")


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, n_byte_tokens, ids_sha256 (of little-endian int32), text_sha256 and decoded_sha256 (of
    UTF-8), round_trip; and the columns `carry` of docs; if `whole`, the text and its ids themselves as well. Null text counts as empty. A text with the mark itself comes
    back with spaces, and round_trip is false for it."""
    import hashlib

    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), *carry)
    shared = docs.sparkSession.sparkContext.broadcast(parse_model(path))
    fields = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    names = ["doc_id", *carry, "n_tokens", "n_byte_tokens", "ids_sha256", "text_sha256", "decoded_sha256", "round_trip", *(("text", "ids") if whole else ())]

    def run(batches):
        import pyarrow as pa

        m = shared.value
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for b in sliced(batches, "__text"):
            text = b.column("__text")
            ids, offsets = encode_batch(m, text)
            decoded = decode_batch(m, ids, offsets)
            data, at = text_buffer(text)
            raw = [data[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            byte = np.r_[0, np.cumsum(m.kinds[ids] == BYTE)]
            own = [b.column(c) for c in ("doc_id", *carry)]
            texts, back = [sha(r) for r in raw], [sha(d) for d in decoded]
            out = [text, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))] if whole else []
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(np.diff(offsets)), pa.array(np.diff(byte[offsets])), pa.array([sha(ids[i:j].astype("<i4").tobytes()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string()),
                 pa.array(texts, pa.string()), pa.array(back, pa.string()), pa.array([r == d for r, d in zip(raw, decoded)], pa.bool_()), *out], names,
            )

    return x.mapInArrow(run, f"{fields}, n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, text_sha256 string, decoded_sha256 string, round_trip boolean" + ", text string, ids array<int>" * whole)
