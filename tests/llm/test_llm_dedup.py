import random
import time
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxelloom.llm import exact_dedup, line_dedup, simhash

DOCS = "/root/testdata/sf0.001/documents.parquet"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_groups(pairs):
    by = defaultdict(list)
    for i, t in pairs:
        by[t or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}


def test_exact_groups_with_clashing_digests(spark, odd):
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute_groups(pairs)
    for digest in (exact_dedup.sha256, lambda t: F.substring(t, 1, 1), lambda t: F.lit("same")):
        got = rows(exact_dedup.groups(odd, salts=3, digest=digest).drop("digest"))
        assert got == sorted(((i, *want[t or ""], i == want[t or ""][0]) for i, t in pairs), key=repr)


def test_exact_dedup_keeps_columns(odd, none):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and {r.text for r in kept.collect()} >= {"a", "b", "a\na\na"}
    assert exact_dedup.deduplicate(none).count() == exact_dedup.groups(none).count() == 0


def naive_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_naive_one(spark, odd):
    for r in odd.collect() + spark.read.parquet(DOCS).limit(40).collect():
        assert simhash.fingerprint(r.text or "") & (2**64 - 1) == naive_fingerprint(r.text or "")



def test_links_find_every_pair_once(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 150, dtype=np.int64)
    values = set(base.tolist())
    for b in base.tolist():
        for k in (1, 2, 3):
            flip = sum(1 << int(i) for i in rng.choice(64, k, replace=False))
            values.add(int(np.uint64((b ^ flip) & (2**64 - 1)).astype(np.int64)))
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_anchor_code_is_perfect():
    code = simhash.Code()
    assert [len(s[0]) for s in code.shells] == [2048, 8855, 33649] and (code.shells[0][2] == 1).all()


def components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_components_match_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    fps = {r.doc_id: naive_fingerprint(r.text or "") for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, salts=2).collect()}
    assert got == components(fps)
    kept = simhash.deduplicate(docs)
    assert {r.doc_id for r in kept.collect()} == set(components(fps).values()) and kept.columns == docs.columns


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count()
    assert {r.component_id for r in got.where("fp = 0").collect()} == {2}
    assert simhash.deduplicate(odd).columns == odd.columns
    assert simhash.near_duplicates(none).count() == simhash.deduplicate(none).count() == 0


def brute_lines(docs, t=0.8):
    """Line numbers that go, by document number."""
    seen, out = [], defaultdict(list)
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            s = frozenset(line.lower().split())
            if s and any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen):
                out[i].append(n)
            if s:
                seen.append(s)
    return dict(out)


def line_texts(n=60, seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))] for _ in range(25)]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            words = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            lines.append(" ".join(words) if rnd.random() < 0.9 else "")
        out.append("\n".join(lines))
    return out


@pytest.fixture
def small(monkeypatch):
    """Bucket tables so small that many words share a bucket."""
    monkeypatch.setattr(line_dedup, "BUCKET_BITS", 11)
    monkeypatch.setattr(line_dedup, "FLAG_BITS", 10)


def removed(df):
    return {r.doc_id: list(r.removed) for r in df.collect() if r.removed}


def test_similar_lines_match_brute_force(texts, monkeypatch, small):
    docs = line_texts()
    want = brute_lines(enumerate(docs))
    assert sum(map(len, want.values())) > 50
    assert removed(line_dedup.removals(texts(*docs))) == want
    monkeypatch.setattr(line_dedup, "HOT_BITS", 2)  # nearly all words take the two-step way
    monkeypatch.setattr(line_dedup, "LONG", 8)
    assert removed(line_dedup.removals(texts(*docs))) == want
    assert removed(line_dedup.removals(texts(*docs), t=0.5)) == brute_lines(enumerate(docs), 0.5)


def test_line_dedup_rewrites_texts(odd, none, texts, small):
    docs = texts("a b c d e\nkeep one", "A b  c e d\nkeep two\n\n", "x")
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(docs).collect()}
    assert got == {0: "a b c d e\nkeep one", 1: "keep two\n\n", 2: "x"}
    out = line_dedup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by = [(r.doc_id, r.text) for r in out.collect()]
    assert by.count((1, "one two three four five six\nseven")) in (0, 2)  # repeated rows come out alike
    assert (2, None) in by and (8, "") in by
    assert line_dedup.deduplicate(none).count() == 0


def test_many_removed_lines_of_one_text(texts, small):
    lines = [f"left{i} right{i} middle{i}" for i in range(30_000)]
    begun = time.monotonic()
    got = line_dedup.deduplicate(texts("\n".join(lines), "\n".join([*lines[::-1], "new one here"]))).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["\n".join(lines), "new one here"]
    assert time.monotonic() - begun < 60


def test_only_lines_that_go_are_grouped(texts, small):
    docs = texts("a b c d e\nkeep one", "A b  c e d\nkeep two", "stays whole")
    assert [(r.doc_id, list(r.removed)) for r in line_dedup.removals(docs).collect()] == [(1, [0])]


def test_verification_splits_each_line_once(spark, texts, small):
    docs = texts("a b c d e f", "a b c d e f g")
    lines = line_dedup.lines_of(docs)
    place = F.struct(F.col("_pos").alias("pos"), "h1")
    pairs = lines.where("doc_id = 1").select(F.lit(1).alias("late"), place.alias("at")).crossJoin(lines.where("doc_id = 0").select(place.alias("before")))
    found = line_dedup.similar(pairs, lines, 0.8)
    assert found.collect() == [(1,)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
