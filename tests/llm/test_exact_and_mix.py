import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

from fieldloom.llm import exact_dedup, license_scan, mixing, url_filter

LONG = "word " * 40_000


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(texts):
    values = ["a  b", "a\tb", "a b ", None, "", "  ", " ", LONG, LONG + " ", "é\u00a0x", "a b", "\n\x0b\x0c"]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(texts(values, norm="clash", key="clash")).collect()}
    groups = defaultdict(list)
    for i, v in enumerate(values):
        groups[norm(v)].append(i)
    for members in groups.values():
        for i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (members[0], len(members), i == members[0])
            assert r.text_sha256 == hashlib.sha256(norm(values[i]).encode()).hexdigest()
    assert exact_dedup.exact_groups(texts([])).count() == 0


def test_exact_collision(texts, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(texts(["a", "b", "a", "c", "b"])).collect()}
    assert got == {0: (0, 2), 1: (1, 2), 2: (0, 2), 3: (3, 1), 4: (1, 2)}


def test_drop_exact(texts):
    docs = texts(["a b", "a  b", "c", None, ""])
    assert sorted(r.doc_id for r in exact_dedup.drop_exact(docs).collect()) == [0, 2, 3]


def test_license_base_places(texts):
    values = ["MIT License. mit-license; the MIT\nLicense", "apache license general public license", "mit licenses", None, "", "MIT", "KIT lİcense mit license", "licensed under cc by nc 4 0", LONG + "mit license"]
    got = {r.doc_id: r for r in license_scan.scan(texts(values, words="clash", hash="clash")).collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        places = [(k, label) for label, phrase in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert r.n_words == len(words) and r.n_base == len(places)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    assert got[7].labels == "cc-by-nc"
    assert license_scan.scan(texts([])).count() == 0


def test_license_spans_bear_small_changes(texts):
    full = license_scan.TEMPLATES[1][1].split()
    less = " ".join(w for i, w in enumerate(full) if i != 6)
    spread = " ".join(w + " x y z" for w in full)
    got = {(r.doc_id, r.label) for r in license_scan.spans(texts([" ".join(full), less, spread, "of this software"])).collect()}
    assert got == {(0, "bsd"), (1, "bsd")}


def test_mix_against_plain_version(texts, spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        source = rng.choice([None, "a", "a", "a", "b", "é", "Z"])
        rows.append((i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 30, 900]))), source, "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    a = mixing.plan(docs, block=16, shard=5000).select("doc_id", "source_size", "target", "taken").collect()
    b = mixing.plan(docs.repartition(7), block=16, shard=5000).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in a} == {r.doc_id: r.taken for r in b}
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, budget, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        budget -= sum(2 * sizes[s] for s in over)
        open_ -= over
    taken = Counter()
    for r in a:
        _, t, s, _ = rows[r.doc_id]
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 2 * len(t.split())
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 200


def test_apply_mix_takes_the_words_of_the_plan(texts, spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(rng.choice([0, 3, 200]))), "en", rng.choice("abc"), 0) for i in range(80)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = {r.doc_id: r.taken for r in mixing.plan(docs, block=16).select("doc_id", "taken").collect()}
    got = Counter()
    for r in mixing.apply_mix(docs, block=16).collect():
        assert r.text.split()[0].startswith(f"d{r.doc_id}w")
        got[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in plan.items() if v} == dict(got)


def test_mix_of_nothing(texts):
    assert mixing.plan(texts([])).count() == 0
    assert [r.taken for r in mixing.plan(texts([None, ""])).select("taken").collect()] == [0, 0]


def test_seats_are_those_of_the_highest_quotients(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(g, i, rng.randint(0, 1000) ** 2) for g in "xyz" for i in range(rng.randint(1, 40))]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g string, tie long, words long"), ["g"], F.lit(97).cast("long"), F.col("words")).collect()
    for g in "xyz":
        own = [(i, w) for h, i, w in rows if h == g]
        quotients = sorted(((-w / (2 * k + 1), i, k) for i, w in own if w for k in range(98)))[:97]
        want = Counter(i for _, i, _ in quotients)
        assert {r.tie: r.seats for r in got if r.g == g} == {i: want.get(i, 0) for i, _ in own}


def test_urls(spark, sf):
    urls = ["HTTP://WWW.Example.COM/en/7x?q", "https://example.com/en/8", "x://a.net", "http://net/de/", "http://example.net/de/8#f", "http://b.example.net/de/9", "http://evilnet/de/", "no scheme", None, "", "a://b://c/d", "http://ÄB.org/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got[0] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2] == ("a.net", "", None, "allow")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5][2] == "net/de/"
    assert got[6][2] is None and got[7][:2] == ("", "") and got[8][:2] == ("", "") and got[9][:2] == ("", "")
    assert got[10][:2] == ("b:", "//c/d") and got[11][:3] == ("Äb.org", "/es/", "org/es/")


def test_rules_are_mined_and_matched(spark):
    pages = [(i, f"http://{'spam' if i % 2 else 'good'}.x.org/{'ad' if i % 3 else 'news'}/{i}") for i in range(300)]
    labels = [(i, 0 if i % 2 and i % 3 else 1, 0) for i in range(200)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules=(), min_lift=2.9).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i in range(300) if i % 2 and i % 3}


def test_rules_of_any_length_match_brute_force(texts, spark):
    """Bad where all of three keys are; no pair of them, nor the rest of the URL, tells."""
    rng = random.Random(12)
    keys = ["abc"] * 30 + ["ab", "ac", "bc"] * 40 + ["abcde", "abd", "ace", "bcd"] * 8 + ["".join(k for k in "abcde" if rng.random() < 0.5) for _ in range(60)]
    pages = [(i, f"http://h.org/x/{i}?" + "&".join(f"{k}=1" for k in some)) for i, some in enumerate(keys)]
    bad = [set("abc") <= set(some) for some in keys]
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)], "doc_id long, quality int")
    fixed = {"scheme=http", "label=h", "label=org", "domain=h.org", "segment=x", "segment=#"}
    held = [sorted(fixed | {f"key={k}" for k in some}) for some in keys]
    seen, hits = Counter(), Counter()
    for b, t in zip(bad, held):
        for n in range(1, len(t) + 1):
            for s in itertools.combinations(t, n):
                seen[s] += 1
                hits[s] += b
    base = sum(bad) / len(bad)
    rules = [set(s) for s in seen if hits[s] >= 20 and hits[s] / seen[s] >= 3 * base]
    want = {i: any(r <= set(t) for r in rules) for i, t in enumerate(held)}
    assert min(map(len, rules)) == 3 and any(want.values()) and not all(want.values())
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), labels, rules=(), min_count=20, min_lift=3).collect()
    assert {r.page_id: r.verdict == "block" for r in got} == want


def test_mined_rules_decide_verdicts_of_the_given_pages(spark):
    for sf in ("sf0.01", "sf0.1"):
        pages, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("pages", "labels"))
        with_rules = url_filter.judge(pages, labels).where("rule is null and verdict = 'block'").count()
        assert with_rules > 0 and url_filter.judge(pages, labels, min_lift=1e9).where("rule is null and verdict = 'block'").count() == 0


def test_pages_of_nothing_and_repeated_ids(spark):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), labels).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (None, "http://a.org/x"), (1, None)], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in url_filter.judge(pages, labels).collect()) == [(0, "allow"), (1, "allow"), (1, "block"), (1, "block")]


def test_license_rows_with_one_id_are_judged_alone(spark):
    rows = [(1, "general public x"), (1, "x public license"), (2, "mit license"), (2, "mit license"), (None, "mit license"), (None, "a"), (2, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.base_labels) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 3, 0, ""), (1, 3, 0, ""), (2, 2, 1, "mit"), (2, 2, 1, "mit"), (0, 2, 1, "mit"), (0, 1, 0, ""), (2, 0, 0, "")])


def test_blocks_go_to_the_sources_with_the_highest_quotients(spark):
    """Ten equal sources of which each has a target of 1.5 blocks: fifteen blocks in all, never ten or twenty."""
    rows = [(s * 10 + i, " ".join(["w"] * 16), f"s{s}") for s in range(10) for i in range(1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.source: r.taken for r in mixing.plan(docs, block=16, weights=(1,)).select("source", "taken").collect()}
    assert sum(taken.values()) == 15 * 16 and set(taken.values()) == {16, 32}
    assert [taken[f"s{s}"] for s in range(10)] == [32] * 5 + [16] * 5  # ties go to the smaller name
    # ids that repeat are rows of their own
    both = docs.union(docs)
    assert mixing.plan(both, block=16).count() == 20
