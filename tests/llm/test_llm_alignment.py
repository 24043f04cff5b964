import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxelloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Both libraries, used directly."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    return one, two


def spelled(plain, text):
    one, two = plain
    a = one.encode(" " + text, add_special_tokens=False)
    byte = alignment.byte_of_character()
    left = [(i, bytes(byte[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
    right = []
    for i in two.encode(text):
        piece = two.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()))
    return left, right


def naive_groups(left, right):
    """Cut where the set of ends of both sides agrees."""

    def ends(tokens):
        out, at = [], 0
        for _, t in tokens:
            at += len(t)
            out.append(at)
        return out

    x, y = ends(left), ends(right)
    out, i, j = [], 0, 0
    for end in sorted(set(x) & set(y)):
        p, q = x.index(end) + 1, y.index(end) + 1
        out.append(([t for t, _ in left[i:p]], [t for t, _ in right[j:q]]))
        i, j = p, q
    return out


def naive(plain, rows):
    found, holders = [], Counter()
    for doc, text in rows:
        left, right = spelled(plain, text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or any(b"".join(t for _, t in side) != want for side in (left, right)):
            found.append((doc, None, None, []))
            continue
        groups = naive_groups(left, right)
        found.append((doc, left, right, groups))
        holders.update({(a, b) for g in groups for a in g[0] for b in g[1]})
    top = defaultdict(int)
    for (a, _), n in holders.items():
        top[a] = max(top[a], n)
    out = []
    for doc, left, right, groups in found:
        if left is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, len(left), len(right), len(groups), len(links), sum(holders[p] == top[p[0]] for p in links), sum(holders[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


TEXTS = ["one two three", "one two three", "", None, " ", "\n\t x  y", "naïve café — “quoted”", "日本語のテキスト", "🙂🙂 emoji 👩‍👩‍👧", "a▁b", "<s> <|endoftext|> </s> <unk>",
         "x" * 5000, "ab " * 3000, "\x00\x01 odd", "thonheerst ererthan onthlyed.", "1234567890 12 345", "Unaffable\r\nlines", "  leading", "trailing  "]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_rows_are_the_naive_ones(spark, plain, monkeypatch, limit):
    """With the count table broadcast, and joined."""
    real = alignment.join_small
    monkeypatch.setattr(alignment, "join_small", lambda *a: real(*a, limit=limit))
    rows = list(enumerate(TEXTS)) + [(None, "one two"), (3, "one more"), (0, "one two three")]
    docs = spark.createDataFrame([(i, t, 1, "p", "q") for i, t in rows], "doc_id long, text string, n_a long, _pair string, _row string")
    assert sorted(map(tuple, alignment.alignment(docs, A, B).collect()), key=repr) == naive(plain, rows)


def test_rows_of_the_table(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if len(r[1] or "") < 20_000]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, alignment.alignment(some, A, B).collect()), key=repr) == naive(plain, rows)


def test_no_rows_and_odd_rows(odd, none):
    assert alignment.alignment(none, A, B).count() == 0
    got = alignment.alignment(odd, A, B).collect()
    assert len(got) == odd.count() and sum(r.n_a == 0 for r in got) == 3


def test_wide_groups(monkeypatch, plain):
    left, right = spelled(plain, "thonheerst ererthan onthlyed aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa")
    ids = [alignment.np.array([t for t, _ in side]) for side in (left, right)]
    ends = [alignment.np.array([len(side) - 1]) for side in (left, right)]  # all in one group
    want = [x.tolist() for x in alignment.linked(*ids, *ends)]
    monkeypatch.setattr(alignment, "WIDE", 1)
    assert [x.tolist() for x in alignment.linked(*ids, *ends)] == want and sum(want[1]) == len(left) * len(right)


ENDS = st.sets(st.integers(1, 60), min_size=0, max_size=50)


@given(ENDS, ENDS)
@settings(max_examples=400, deadline=None)
def test_meets_are_the_common_values(x, y):
    a, b = sorted(x | {61}), sorted(y | {61})
    i, j = alignment.meets(a, b)
    both = sorted(set(a) & set(b))
    assert [a[k] for k in i] == both and [b[k] for k in j] == both


def test_long_runs_and_shifts():
    a = list(range(1, 5000)) + [5002, 5003] + list(range(5010, 9000))
    b = list(range(1, 5000)) + [5001, 5003, 5004, 5005] + list(range(5010, 9000))
    i, j = alignment.meets(a, b)
    assert [a[k] for k in i] == sorted(set(a) & set(b)) == [b[k] for k in j]


def test_groups_cover_the_text(spark, plain):
    text = "naïve café — “quoted” thonheerst"
    rows = alignment.groups(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), A, B).orderBy("group_no").collect()
    assert [(r.a_ids, r.b_ids) for r in rows] == naive_groups(*spelled(plain, text))
    assert rows[0].start == 0 and rows[-1].end == len((" " + text).encode()) and all(p.end == q.start for p, q in zip(rows, rows[1:]))
