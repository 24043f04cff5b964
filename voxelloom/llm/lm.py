"""Language-model scoring with a log-bilinear model.

Counts of every training word are summed over the corpus.  The model predicts
a word's *class* from the two before it: the ``TOP`` most frequent words are
classes of their own, all other words fall into ``SUFFIXES`` classes by their
last two bytes, within which they share the class's probability by count
(add-one, with one slot for words never seen).  So the probabilities of all
words that follow a context sum to one.

The class model is log-bilinear: the context vector is a bilinear form of the
class vectors before, the score its product with the vector of the next class.
Each task trains a replica on its own documents by noise-contrastive
estimation, in minibatches of matrix products; replicas are averaged, weighted
by their tokens, and the next round goes on from there with other documents,
until all training documents were used.  Scoring normalises exactly: one batched
matrix product per block of the distinct contexts of a batch.

The ``HEAD`` most frequent words are sent to the tasks with their counts; the
other words of a document, with how often it has them, meet their counts in a
join by word.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm.common import fold_of, query, table, whole_text
from voxelloom.session import cut

FOLDS, HELD_OUT = 7, 2
END = b"\n"  # no word holds a line break
TOP, SUFFIXES, WIDTH = 448, 64, 24
CLASSES = TOP + SUFFIXES
#: Words sent to the tasks, at most; the rest is joined.
HEAD = 200_000
ROUNDS, MINIBATCH, NOISE, RATE, FIRST_SCALE = 2, 1024, 64, 0.05, 1e-7
FLUSH = 500_000
LN10 = np.log(10.0)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def suffix(word: bytes) -> int:
    return (word[-1] * 31 + word[-2:][0]) % SUFFIXES


def count_words(train: DataFrame) -> DataFrame:
    """``word, suffix, n`` over all training texts, the end included; materialised."""

    def run(batches):
        held: Counter = Counter()

        def out():
            frame = pd.DataFrame({"word": list(held), "suffix": [suffix(w) for w in held], "n": list(held.values())})
            held.clear()
            return frame

        for b in batches:
            for text in b["_text"]:
                held.update(words_of(text))
                held[END] += 1
                if len(held) > FLUSH:
                    yield out()
        if held:
            yield out()

    return cut(train.select("_text").mapInPandas(run, "word binary, suffix int, n long").groupBy("word", "suffix").agg(F.sum("n").alias("n")))


class Vocabulary:
    """The head words by falling count, and the totals behind the classes."""

    def __init__(self, counts: DataFrame, head: int = HEAD):
        step = F.floor(F.log2("n") * 8)  # a few hundred buckets whatever the corpus
        by_step = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("types"), F.min("n").alias("least")).collect(), reverse=True)
        least, held = 1 << 62, 0
        for r in by_step:
            if held + r.types > head:
                break
            held, least = held + r.types, r.least
        rows = sorted((-r.n, bytes(r.word)) for r in counts.where(F.col("n") >= least).select("word", "n").collect())
        self.index = {w: i for i, (_, w) in enumerate(rows)}
        self.count = np.array([-n for n, _ in rows], np.int64)
        top = [w for _, w in rows[:TOP]]
        self.classes = np.array([i if i < TOP else TOP + suffix(w) for i, (_, w) in enumerate(rows)], np.int64)
        tokens, types = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
        for r in counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
            tokens[r.suffix], types[r.suffix] = r.n, r.types
        self.tokens, self.types = int(tokens.sum()), int(types.sum())
        for i, w in enumerate(top):
            tokens[suffix(w)] -= self.count[i]
            types[suffix(w)] -= 1
        self.class_tokens = np.concatenate([np.pad(self.count[:TOP], (0, TOP - len(top))), tokens])
        self.class_mass = tokens + types + 1  # of the shares within a suffix class

    def number(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(head number or -1, class) of each word."""
        at = np.fromiter(map(self.index.get, words, [-1] * len(words)), np.int64, len(words))
        known = at >= 0
        cls = np.empty(len(words), np.int64)
        cls[known] = self.classes[at[known]]
        rest = np.flatnonzero(~known)
        cls[rest] = [TOP + suffix(words[i]) for i in rest.tolist()]
        return at, cls


class Model:
    """Vectors of the classes as context (r) and as target (q), one matrix per
    context position, and a bias."""

    SHAPES = (("r", (CLASSES, WIDTH)), ("q", (CLASSES, WIDTH)), ("m1", (WIDTH, WIDTH)), ("m2", (WIDTH, WIDTH)), ("b", (CLASSES,)))

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES:
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def fresh(cls, tokens: np.ndarray) -> Model:
        rng = np.random.default_rng(5)
        size = sum(int(np.prod(s)) for _, s in cls.SHAPES)
        model = cls(rng.normal(0, 0.1, size).astype(np.float32))
        model.m1[:] += np.eye(WIDTH, dtype=np.float32) * 0.5
        model.m2[:] += np.eye(WIDTH, dtype=np.float32)
        model.b[:] = np.log((tokens + 1) / (tokens.sum() + CLASSES))
        return model

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] @ self.m1 + self.r[two] @ self.m2

    def train(self, streams, noise: np.ndarray, rng) -> int:
        """One pass of noise-contrastive estimation (Adagrad) over arrays of
        (class two before, class before, class); returns how many tokens."""
        scale = {name: np.full(shape, FIRST_SCALE, np.float32) for name, shape in self.SHAPES}
        log_noise = np.log(NOISE * noise).astype(np.float32)
        edges, seen = np.cumsum(noise), 0
        for one, two, next_ in streams:
            order = rng.permutation(len(next_))
            for i in range(0, len(order), MINIBATCH):
                self.step(one[order[i : i + MINIBATCH]], two[order[i : i + MINIBATCH]], next_[order[i : i + MINIBATCH]],
                          np.minimum(np.searchsorted(edges, rng.random(NOISE)), CLASSES - 1), log_noise, scale)
            seen += len(next_)
        return seen

    def step(self, one, two, next_, fake, log_noise, scale):
        n = len(next_)
        a, c = self.r[one], self.r[two]
        q = a @ self.m1 + c @ self.m2
        target, wrong = self.q[next_], self.q[fake]
        real = sigmoid(log_noise[next_] - (q * target).sum(1) - self.b[next_]) / n  # 1 - P(real)
        false = -sigmoid(q @ wrong.T + self.b[fake] - log_noise[fake]) / n
        dq = real[:, None] * target + false @ wrong
        grads = {
            "m1": a.T @ dq, "m2": c.T @ dq,
            "r": scatter(one, dq @ self.m1.T) + scatter(two, dq @ self.m2.T),
            "q": scatter(next_, real[:, None] * q) + scatter(fake, false.T @ q),
            "b": np.bincount(next_, real, CLASSES).astype(np.float32) + np.bincount(fake, false.sum(0), CLASSES).astype(np.float32),
        }
        for name, g in grads.items():
            scale[name] += g * g
            getattr(self, name)[...] += RATE * g / np.sqrt(scale[name])

    def log_probability(self, one, two, next_) -> np.ndarray:
        """Natural log of the class probabilities, exactly normalised."""
        pair = one * CLASSES + two
        seen = np.zeros(CLASSES * CLASSES, bool)
        seen[pair] = True
        distinct = np.flatnonzero(seen)
        out = np.empty(len(next_), np.float64)
        norm = np.empty(len(distinct), np.float64)
        vectors = self.context(distinct // CLASSES, distinct % CLASSES)
        for i in range(0, len(distinct), 4096):
            s = vectors[i : i + 4096] @ self.q.T + self.b
            top = s.max(1)
            norm[i : i + 4096] = top + np.log(np.exp(s - top[:, None]).sum(1))
        place = np.zeros(CLASSES * CLASSES, np.int32)
        place[distinct] = np.arange(len(distinct))
        at = place[pair]
        for i in range(0, len(next_), 1 << 16):
            j = slice(i, i + (1 << 16))
            out[j] = np.einsum("ij,ij->i", vectors[at[j]], self.q[next_[j]]) + self.b[next_[j]] - norm[at[j]]
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scatter(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values (rows of WIDTH) by class."""
    flat = (rows[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    return np.bincount(flat, values.ravel(), CLASSES * WIDTH).astype(np.float32).reshape(CLASSES, WIDTH)


def stream(vocabulary: Vocabulary, texts) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, all words, and by token head number, the two
    classes before and its own; before a text stand two ends."""
    sizes, words = [], []
    for t in texts:
        w = words_of(t)
        sizes.append(len(w) + 1)
        words += w
        words.append(END)
    at, cls = vocabulary.number(words)
    before = np.empty_like(cls)
    before[1:] = cls[:-1]
    first = np.cumsum(sizes) - sizes
    end = vocabulary.number([END])[1][0]
    before[first] = end
    older = np.empty_like(cls)
    older[1:] = before[:-1]
    older[first] = end
    return sizes, words, at, older, before, cls


def fit(train: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Average of the replicas that the tasks train, round by round; each
    training document (``_text, _hash``) takes part in one round."""
    model = Model.fresh(vocabulary.class_tokens)
    noise = (vocabulary.class_tokens + 1.0) / (vocabulary.class_tokens.sum() + CLASSES)
    for number in range(rounds):
        start = model.flat.copy()

        def run(batches, start=start, number=number):
            replica, seen, rng = Model(start.copy()), 0, None
            for b in batches:
                for i in range(0, len(b), 1024):
                    texts = b["_text"].iloc[i : i + 1024].tolist()
                    rng = rng or np.random.default_rng(zlib.crc32(texts[0].encode("utf-8", "surrogatepass")) + number)
                    *_, one, two, next_ = stream(vocabulary, texts)
                    seen += replica.train([(one, two, next_)], noise, rng)
            if seen:
                yield pd.DataFrame({"tokens": [seen], "flat": [(replica.flat.astype(np.float64) * seen)]})

        share = train.where(F.pmod(F.col("_hash"), F.lit(rounds)) == number).select("_text")
        summed = share.mapInPandas(run, "tokens long, flat array<double>").select("tokens", F.posexplode("flat").alias("at", "value"))
        rows = summed.groupBy("at").agg(F.sum("value") / F.sum("tokens")).collect()  # one row per parameter
        flat = start.copy()
        for at, value in rows:
            flat[at] = value
        model = Model(flat)
    return model


def score(docs: DataFrame, held_out, vocabulary: Vocabulary, counts: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    log_count = np.log10(vocabulary.count + 1.0)
    log_mass = np.log10(np.maximum(vocabulary.class_mass, 1))
    per_token = np.log10(vocabulary.tokens + vocabulary.types + 1.0)

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.iloc[i : i + 1024]
                sizes, words, at, one, two, cls = stream(vocabulary, part["_text"].tolist())
                owner = np.repeat(np.arange(len(part)), sizes)
                known = at >= 0
                log_c = np.where(known, log_count[np.maximum(at, 0)] if len(log_count) else 0.0, 0.0)
                shared = cls >= TOP
                ours = model.log_probability(one, two, cls) / LN10 + np.where(shared, log_c - log_mass[np.maximum(cls - TOP, 0)], 0.0)
                rest: list[Counter] = [Counter() for _ in sizes]
                for j in np.flatnonzero(~known).tolist():
                    rest[owner[j]][words[j]] += 1
                n = len(part)
                yield pd.DataFrame({
                    "_row": part["_row"], "doc_id": part["doc_id"], "held_out": part["held_out"], "n_tokens": sizes,
                    "_known": np.bincount(owner[known], minlength=n), "_base": np.bincount(owner, log_c, n) - np.array(sizes) * per_token,
                    "_score": np.bincount(owner, ours, n), "_words": [list(c) for c in rest], "_times": [list(c.values()) for c in rest]})

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", held_out.alias("held_out"), whole_text().alias("_text"))
    done = cut(rows.mapInPandas(run, "_row long, doc_id long, held_out boolean, n_tokens long, _known long, _base double, _score double, "
                                     "_words array<binary>, _times array<long>"))
    rare = done.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("w")).select("_row", F.col("w._words").alias("word"), F.col("w._times").alias("times"))
    met = rare.join(counts.select("word", "n"), "word").groupBy("_row").agg(
        F.sum("times").alias("_more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_log"))
    more, log = F.coalesce("_more", F.lit(0)), F.coalesce("_log", F.lit(0.0))
    return done.drop("_words", "_times").join(met, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("_known") + more).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + log).alias("base_score"), (F.col("_score") + log).alias("score"))


def score_texts(docs: DataFrame, held_out, head: int = HEAD) -> DataFrame:
    """Train on the rows where ``held_out`` is false and score every row.

    Null text counts as empty and is the end alone; repeated rows are counted
    and scored each.  Without training rows all words are unknown.
    """
    train = docs.where(~held_out).select(whole_text().alias("_text"), F.xxhash64("doc_id").alias("_hash"))
    counts = count_words(train)
    vocabulary = Vocabulary(counts, head)
    return score(docs, held_out, vocabulary, counts, fit(train, vocabulary))


@query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), FOLDS) == HELD_OUT)
