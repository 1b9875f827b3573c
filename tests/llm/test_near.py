import hashlib
import random
import re
from collections import Counter

from fieldloom.llm import edit_fingerprint, ngram_join, suffix_dedup


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(values, k, num, den):
    sets = [shingles(v, k) for v in values]
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * den >= max(len(a), len(b)) * num and den * len(a & b) >= num * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, words, share, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


def near_copies(seed, groups, members, length, share):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    values = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        values += [" ".join(edited(rng, base, share * rng.random(), vocabulary)) for _ in range(members)]
    rng.shuffle(values)
    return values


def components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_components_small_cases(texts):
    values = ["a b c d", "A b  c\td", None, "", " \n", "x y", "X Y", "x", "é É", "é é", "a b c d e f g h i j k l", "a b c d e f g h i j k l m", "word " * 30_000, "word word word", "a b c d"]
    got = components(ngram_join.near_components(texts(values, n="clash", rep="clash"), 3, 90, 100))
    assert [got[i] for i in range(len(values))] == brute(values, 3, 90, 100)
    assert ngram_join.near_components(texts([])).count() == 0


def test_near_components_match_brute_force(texts):
    for k, num, den, share in ((3, 90, 100, 0.02), (5, 80, 100, 0.03)):
        values = near_copies(k, 6, 25, 150, share) + near_copies(k + 9, 60, 1, 80, 0)
        got = components(ngram_join.near_components(texts(values), k, num, den))
        assert [got[i] for i in range(len(values))] == brute(values, k, num, den)


def test_long_near_copies_share_several_prefix_shingles(texts):
    values = near_copies(3, 3, 14, 450, 0.03) + near_copies(5, 10, 1, 450, 0)
    got = components(ngram_join.near_components(texts(values), 3, 90, 100))
    assert [got[i] for i in range(len(values))] == brute(values, 3, 90, 100)


def test_large_group_of_near_copies(texts):
    values = near_copies(1, 1, 420, 60, 0.04)
    got = components(ngram_join.near_components(texts(values), 3, 90, 100))
    assert [got[i] for i in range(len(values))] == brute(values, 3, 90, 100)


def test_large_buckets_in_blocks(texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 8)
    values = near_copies(4, 3, 30, 60, 0.05)
    got = components(ngram_join.near_components(texts(values), 3, 90, 100))
    assert [got[i] for i in range(len(values))] == brute(values, 3, 90, 100)


def test_rows_with_one_id_are_one_node(spark, texts):
    rows = [(1, "a b c"), (2, "a b c"), (2, "x y z"), (3, "x y z"), (4, "q r s"), (4, "q r s"), (5, None), (5, "x y z t"), (6, ""), (None, "m n o"), (None, "u v w"), (7, "u v w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.near_components(docs, 3, 90, 100).collect())
    want = [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4), (5, 0, 5), (5, 2, 5), (6, 0, 6), (-1, 1, None), (-1, 1, None), (7, 1, None)]
    assert got == sorted(want, key=lambda r: r[:2])


def test_components_in_one_task_and_by_rounds_agree(spark, texts):
    from fieldloom.llm.components import connected_components

    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 580)] + [(7, 7), (None, 3)]
    edges = spark.createDataFrame(links, "u long, v long")
    a, b = (sorted(map(tuple, connected_components(edges, small=k).collect())) for k in (1 << 17, 0))
    assert a == b and dict(a)[580] == 500


def test_drop_near_keeps_one_of_each(texts):
    docs = texts(["a b c d e f", "a b c d e f", "g h i j k l", ""])
    assert sorted(r.doc_id for r in ngram_join.drop_near(docs).collect()) == [0, 2, 3]


def plain_removal(values, length):
    raw = [(v or "").encode() for v in values]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_removal_matches_brute_force(texts):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abé cd") for _ in range(n))
    passages = [text(n) for n in (20, 45, 120, 300)]
    values = ["".join(rng.choice([text(30), text(80), rng.choice(passages)]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    values += [None, "", "short", "ab" * 300, "x" * 5000, values[3], values[3]]
    for hot in (20_000, 2):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(texts(values, h="clash", k1="clash"), length=50, q=16, hot=hot).collect()}
        assert [got[i] for i in range(len(values))] == plain_removal(values, 50)
    assert suffix_dedup.remove_repeats(texts([])).count() == 0


def plain_edit(values):
    out = []
    for i, v in enumerate(values):
        v, after = v or "", values[(i + 1) % len(values)] or ""
        n = len(v) // 4
        out.append(v[: len(v) - n] + after[:n])
    return out


def test_edited_fingerprints(texts, spark):
    rng = random.Random(8)
    values = ["".join(rng.choice("abcdeé 日😀") for _ in range(rng.choice([0, 1, 3, 4, 50, 900, 5000]))) for _ in range(120)] + [None, "", "same text " * 50, "same text " * 50]
    got = {r.doc_id: r for r in edit_fingerprint.edited_fingerprints(texts(values, bucket="clash", copy="clash").repartition(5)).collect()}
    own = {r.doc_id: r for r in edit_fingerprint.fingerprints(texts(values)).collect()}
    other = {r.doc_id: r for r in edit_fingerprint.fingerprints(texts(plain_edit(values))).collect()}
    for i, e in enumerate(plain_edit(values)):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(values[i] or ""), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own[i].fingerprint, other[i].fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(values[i] or "") >= 900:
            assert r.near_edited > r.near_next or values[i] == values[(i + 1) % len(values)]
    n = len(values)
    assert got[n - 2].near_next == 1.0 and got[n - 2].fingerprint == got[n - 1].fingerprint
    assert edit_fingerprint.edited_fingerprints(texts([])).count() == 0
    alone = edit_fingerprint.edited_fingerprints(texts(["abcdefgh"])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0


def test_walk_in_step_is_the_walk_alone():
    import numpy as np

    rng = np.random.default_rng(1)
    size = rng.integers(0, 700, 300)
    code = rng.integers(0, 64, size.sum()).astype(np.uint8)
    ends = np.cumsum(size)
    assert (edit_fingerprint.walk(code, ends - size, ends, few=0) == edit_fingerprint.walk(code, ends - size, ends, few=10**9)).all()


def test_walk_of_a_long_text_is_the_walk_in_parts():
    import numpy as np

    code = np.random.default_rng(5).integers(0, 64, 200_000).astype(np.uint8)
    ends = np.array([200_000])
    assert (edit_fingerprint.walk(code, ends - 200_000, ends, few=0) == edit_fingerprint.walk(code, ends - 200_000, ends)).all()
    data = np.frombuffer(("aé漢𝄞" * 300_000).encode(), np.uint8)
    some, at = edit_fingerprint.classes(data)
    assert len(some) == len(at) == 1_200_000 and (some.reshape(-1, 4) == some[:4]).all()


def test_near_links_find_small_edits(texts):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(1500)) for _ in range(20)]
    values = base + [b[:1400] + "zz" + b[1405:] for b in base]
    got = {(r.doc_id, r.with_id) for r in edit_fingerprint.near_links(edit_fingerprint.fingerprints(texts(values))).collect()}
    assert got == {(i + 20, i) for i in range(20)}


def headed(rng, unlike, groups, members, heading=120, rest=480):
    """Texts under one heading: unlike ones first, then groups of near copies."""
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    top = text(heading)
    values = [top + text(rest) for _ in range(unlike)]
    for _ in range(groups):
        base = text(rest)
        values += [top + base[:at] + "zz" + base[at + 1 :] for at in rng.sample(range(rest - 60, rest - 2), members)]
    return values


def joined(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return [find(i) for i in range(n)]


def test_near_links_when_the_smallest_id_is_another_text(texts):
    values = headed(random.Random(6), 1, 1, 2)
    got = {(r.doc_id, r.with_id) for r in edit_fingerprint.near_links(edit_fingerprint.fingerprints(texts(values)), bands=1).collect()}
    assert got == {(2, 1)}


def test_near_links_join_all_of_a_common_bucket(texts):
    values = headed(random.Random(7), 12, 4, 5)
    want = list(range(12)) + [12 + i // 5 * 5 for i in range(20)]
    docs = texts(values)
    prints = edit_fingerprint.fingerprints(docs)
    for kw in ({}, {"docs": docs}):
        got = [(r.doc_id, r.with_id) for r in edit_fingerprint.near_links(prints, bands=1, **kw).collect()]
        assert joined(len(values), got) == want and len(got) == len(set(got))


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_links_are_verified_on_the_texts(texts):
    rng = random.Random(9)
    base = "".join(rng.choice("abé日😀 ") for _ in range(200))
    values = ["x" * 200, base, base[:160] + "#" * 40, base[:159] + "#" * 41, base[1:], ""]
    docs = texts(values)
    same = edit_fingerprint.fingerprints(docs).selectExpr("doc_id", "n_chars", "first_value(fingerprint) over (order by n_chars desc, doc_id) as fingerprint")  # one bucket
    got = {(r.doc_id, r.with_id): r.likeness for r in edit_fingerprint.near_links(same, docs=docs).collect()}
    near = {(i, j): 1 - plain_distance(values[i], values[j]) / max(len(values[i]), len(values[j])) for i in range(1, 5) for j in range(i)}
    assert all(abs(v - near[k]) < 1e-9 and v >= 0.8 for k, v in got.items())
    assert joined(5, got) == joined(5, [k for k, v in near.items() if v >= 0.8 - 1e-9])


class Rows:
    """Stands for a DataFrame whose batches a test passes to the function of mapInArrow itself."""

    def __init__(self):
        self.sparkSession = type("S", (), {"conf": {"spark.sql.shuffle.partitions": "4"}})

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, _):
        return run


def test_windows_are_refined_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from fieldloom.llm import suffix_dedup

    rng = np.random.default_rng(4)
    n, each = 9000, 336
    raw = rng.integers(97, 123, (n, each), dtype=np.uint8)
    raw[1::2] = raw[::2]  # each bucket has two places, equal throughout
    bucket, place = np.arange(n) // 2, np.arange(n)
    lo = np.zeros(n, np.int32)
    b = pa.RecordBatch.from_arrays(
        [pa.array(bucket), pa.array(lo), pa.array(lo > 0), pa.array(place), pa.array(place), pa.array(lo + 136), pa.array(lo), pa.array(lo + each - 200), pa.array([r.tobytes() for r in raw], pa.binary())],
        ["h", "part", "big", "k1", "k2", "pos", "lo", "hi", "bytes"],
    )
    run = suffix_dedup.repeated_windows(Rows(), 200, 64)
    list(run(iter([b.slice(0, 10)])))
    tracemalloc.start()
    got = [r for out in run(iter([b])) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((r["k1"], r["first"], r["last"]) for r in got) == [(i, 0, 136) for i in range(n)]
    assert peak < 110e6, peak
