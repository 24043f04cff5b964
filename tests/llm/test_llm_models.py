import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voxelloom.llm import lm, packing, quality
from voxelloom.llm.common import fold_of

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# --- quality ------------------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    measured = quality.measure(docs).cache()
    model = quality.train(measured, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    rows = quality.score(measured, model).join(labels.where(fold_of(F.col("doc_id"), 5) == 0), "doc_id").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    good = [r.score >= quality.CUTOFF for r in rows if r.quality]
    bad = [r.score < quality.CUTOFF for r in rows if not r.quality]
    assert np.mean(good) >= 0.98 and np.mean(bad) >= 0.7 and model.pairs


def test_score_is_the_sum_of_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing but an interaction
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    row = x[:1]
    total = model.base + sum(t[np.searchsorted(e, row[0, f], side="right")] for f, (e, t) in enumerate(zip(model.edges, model.tables)))
    total += sum(t[np.searchsorted(model.pair_edges[f], row[0, f], side="right"), np.searchsorted(model.pair_edges[g], row[0, g], side="right")]
                 for (f, g), t in zip(model.pairs, model.pair_tables))
    assert model.score(row)[0] == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (77, 0)], "doc_id long, quality int")
    assert quality.keep(odd, labels).columns == odd.columns
    assert quality.keep(odd, labels.limit(0)).count() == odd.count()  # nothing learnt, nothing rejected
    assert quality.keep(none, labels).count() == 0
    assert quality.score(quality.measure(odd), quality.train(quality.measure(odd), labels)).count() == odd.count()
    assert quality.features("") == quality.features(" \n ") == [0.0] * len(quality.NAMES)


# --- language model -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = fold_of(F.col("doc_id"), lm.FOLDS) == lm.HELD_OUT
    return {r.doc_id: r.text or "" for r in docs.collect()}, lm.score_texts(docs, held, head=3000).collect()


def test_base_score_matches_brute_force(scored):
    texts, rows = scored
    count = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*lm.words_of(t), lm.END])
    total, types = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        words = [*lm.words_of(texts[r.doc_id]), lm.END]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in count for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + types + 1)) for w in words), rel=1e-9)


def test_model_beats_the_base_on_held_out_texts(scored):
    rows = [r for r in scored[1] if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_are_normalised():
    model = lm.Model.fresh(np.arange(lm.CLASSES))
    every = np.arange(lm.CLASSES)
    for one, two in ((0, 1), (5, 5), (511, 30)):
        p = np.exp(model.log_probability(np.full(lm.CLASSES, one), np.full(lm.CLASSES, two), every))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_lm_odd_rows(spark, odd, none):
    got = lm.score_texts(odd, F.coalesce(F.col("doc_id"), F.lit(0)) == 9)
    assert got.count() == odd.count() and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in got.collect())
    assert lm.score_texts(none, F.lit(False)).count() == 0
    alone = lm.score_texts(odd, F.lit(True)).collect()  # no training rows: nothing is known
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in alone)


# --- packing ------------------------------------------------------------------------------------

def whole(rows, docs, length):
    """Every id once and in order, sequences gapless and full; what each holds."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    by, seq = defaultdict(list), defaultdict(int)
    for r in rows:
        by[r.doc_id].append(r)
    for i, text in docs.items():
        ids, at = [*tok.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and list(r.ids) == ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seq[r.sequence_id]
        seq[r.sequence_id] += r.length
    assert sorted(seq) == list(range(len(seq)))
    full = sum(seq.values()) // length
    assert all(seq[k] == length if k < full else seq[k] & (seq[k] - 1) == 0 for k in seq)
    return seq


def test_packing_is_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for length in (1024, 100):
        whole(packing.pieces(docs, TOKENIZER, length).collect(), texts, length)


def test_packing_odd_rows(odd, none):
    rows = packing.pieces(odd, TOKENIZER, 64).collect()
    lone = [r for r in rows if r.doc_id == 2]
    assert len(lone) == 1 and list(lone[0].ids) == [0]
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 1)
    assert packing.pieces(none, TOKENIZER).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_tokenizer(name):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    own.encode_special_tokens = True
    rnd = random.Random(1)
    texts = ["", " ", "a  b", "x\n y", " lead", "trail ", "a b's c't", "<|endoftext|> x", "ü  z", "a　b c", "x\r\ny z", "Ġ a", "a" * 5000]
    texts += ["".join(rnd.choice("ab1 .'\n\té \x1c\x85\xa0 |<>Ġ\U0001f600ś५") for _ in range(30)) for _ in range(1500)]
    got = packing.Encoder(public_tokenizers.path(name)).encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_a_text_get_their_ids(spark, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    rnd = random.Random(3)
    texts = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "a\n<|endoftext|>\n b", "<|endoftext|", "<|ENDOFTEXT|>", "plain"]
    texts += ["".join(rnd.choices(["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "  ", "\n", "é", "ab", "'s", "12"], k=12)) for _ in range(500)]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing.encoder(path).encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    got = defaultdict(list)
    for r in sorted(packing.pieces(docs, path, 64).collect(), key=lambda r: r.start):
        got[r.doc_id] += r.ids
    assert [got[i] for i in range(40)] == [[*w, packing.END] for w in want[:40]]


def test_hilbert_curve_steps_to_neighbours():
    side = 8
    cells = np.array([[x, y, z] for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key) == list(range(side**3)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_ids_survive_storage():
    ids = np.array([0, 1, 65535, 65536, 2**32 - 1], "<u4")
    assert (packing.grow(packing.shrink(ids)) == ids).all()
