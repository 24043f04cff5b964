"""Main text of web pages by a linear-chain conditional random field over the
leaf blocks of the document tree.

A block's features are the tags and class words of its ancestors, its own and
its innermost sectioning tag, and measures of its text: words, share of links,
punctuation, digits, capitals.  Neighbouring labels are tied by transition
weights.  Training maximises the likelihood of labelled pages, with forward
and backward sums over all pages at once; pages are decoded by Viterbi, each by
itself, in one pass over the table without any shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm.common import query, table
from voxelloom.llm.html_blocks import Block, read
from voxelloom.llm.html_samples import ROLES, labelled_pages

#: Labelled pages used for a fit, at most; every page is extracted.
MAX_PAGES = 2000
PAGES = 800
ROUNDS, RATE, RIDGE = 250, 0.1, 2e-5
LEAST = 3  # training blocks a feature must occur in
#: Class words say more about a block by what they are used for than one by one.
ROLE = {w: role for role, words in ROLES.items() for w in words}


def measures(b: Block, title: str) -> list[str]:
    """Features of the block's own text."""
    text, n = b.text, len(b.text)
    words = text.count(" ") + 1
    letters = n - text.count(" ")
    link = b.linked / letters
    digits = sum(map(text.count, "0123456789")) / letters
    upper = sum(map(str.isupper, text[:200])) / min(200, n)
    out = ["bias", f"words:{min(words.bit_length(), 8)}", f"link:{0 if link == 0 else 1 + min(3, int(link * 4))}", f"tag:{b.tag}", f"section:{b.section}"]
    if text[-1] in ".!?…。":
        out.append("stop")
    if "," in text:
        out.append("comma")
    if digits > 0.2:
        out.append("digits")
    if upper > 0.5:
        out.append("capitals")
    if "©" in text:
        out.append("copyright")
    if " | " in text or " · " in text or "»" in text:
        out.append("bars")
    if title and (text.startswith(title) or title.startswith(text)):
        out.append("title")
    return out


def features(blocks: list[Block], title: str) -> list[list[str]]:
    own = [measures(b, title) for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        kinds = {ROLE[w] for w in b.above if w in ROLE}
        nearest = {ROLE[w] for w in b.named if w in ROLE}
        some = own[i] + [f"in~{k}" for k in kinds] + [f"by~{k}" for k in nearest] + [f"{b.section}~{k}" for k in nearest] + [f"at~{ROLE[w]}" for w in b.own if w in ROLE]
        some += [f"in:{w}" for w in b.above] + [f"by:{w}" for w in b.named]
        for name, k in (("last", i - 1), ("next", i + 1)):
            some += [f"{name}:{f}" for f in own[k][1:5]] if 0 <= k < len(own) else [f"{name}:none"]
        out.append(some)
    return out


@dataclass
class Model:
    """Weights for the label "main text"; the other label scores zero."""

    weight: dict[str, float]
    step: np.ndarray  # step[a, b]: from label a to label b
    first: float  # for the label at the start
    last: float  # and at the end

    @property
    def known(self) -> frozenset[str]:
        return frozenset(f.partition(":")[2] for f in self.weight if f.startswith(("in:", "by:"))) | frozenset(ROLE)

    def decode(self, blocks: list[Block], title: str) -> list[bool]:
        """The likeliest labels of a page's blocks (ties: not main text)."""
        if not blocks:
            return []
        get = self.weight.get
        scores = [sum(get(f, 0.0) for f in fs) for fs in features(blocks, title)]
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = 0.0, scores[0] + self.first, []
        for x in scores[1:]:
            from_b = (b + s10 > a + s00, b + s11 > a + s01)
            back.append(from_b)
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + x
        label = b + self.last > a
        out = [label]
        for from_b in reversed(back):
            label = from_b[label]
            out.append(label)
        return out[::-1]

    def text(self, page: str | None, known: frozenset[str] | None = None) -> str:
        """Main text of a page: its blocks joined by line ends."""
        found = read(page or "", self.known if known is None else known)
        return "\n".join(b.text for b, main in zip(found.blocks, self.decode(found.blocks, found.title)) if main)


def labels(blocks: list[Block], text: str) -> np.ndarray:
    """1 for the blocks that are lines of the labelled text, matched in order."""
    out = np.zeros(len(blocks))
    for m in SequenceMatcher(None, [b.text for b in blocks], text.split("\n"), autojunk=False).get_matching_blocks():
        out[m.a : m.a + m.size] = 1
    return out


def fit(pages: list[tuple[str, str]], rounds: int = ROUNDS) -> Model:
    """Model of labelled pages, ``(html, main text)``; pages without blocks say nothing."""
    rows, marks, sizes = [], [], []
    for page, text in pages[:MAX_PAGES]:
        found = read(page)
        if found.blocks:
            rows += features(found.blocks, found.title)
            marks.append(labels(found.blocks, text))
            sizes.append(len(found.blocks))
    count = Counter(f for fs in rows for f in fs)
    index = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= LEAST))}
    if not index:
        return Model({}, np.zeros((2, 2)), 0.0, 0.0)
    which = [[index[f] for f in fs if f in index] for fs in rows]
    flat, owner = np.concatenate(which).astype(np.int64), np.repeat(np.arange(len(which)), [len(w) for w in which])
    # blocks in a rectangle of pages by places
    pages_n, longest = len(sizes), max(sizes)
    page_of = np.repeat(np.arange(pages_n), sizes)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.array(sizes)
    there = place_grid = np.zeros((pages_n, longest), bool)
    place_grid[page_of, place] = True
    y = np.zeros((pages_n, longest), int)
    y[page_of, place] = np.concatenate(marks)
    w, extra = np.zeros(len(index)), np.zeros(6)  # extra: 2 x 2 steps, first, last
    slow = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(extra), np.zeros_like(extra)]
    for t in range(1, rounds + 1):
        score = np.zeros((pages_n, longest, 2))
        score[page_of, place, 1] = np.bincount(owner, w[flat], len(rows))
        step = extra[:4].reshape(2, 2)
        score[:, 0, 1] += extra[4]
        score[np.arange(pages_n), size - 1, 1] += extra[5]
        ahead, behind = score.copy(), np.zeros_like(score)
        for i in range(1, longest):
            go = np.logaddexp(ahead[:, i - 1, :1] + step[0], ahead[:, i - 1, 1:] + step[1])
            ahead[:, i] = np.where(there[:, i, None], go + score[:, i], ahead[:, i - 1])
        for i in range(longest - 2, -1, -1):
            onward = score[:, i + 1] + behind[:, i + 1]
            go = np.logaddexp(step[:, 0] + onward[:, :1], step[:, 1] + onward[:, 1:])
            behind[:, i] = np.where(there[:, i + 1, None], go, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        share = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
        miss = np.where(there, y - share, 0.0)
        grad = np.bincount(flat, miss[page_of, place][owner], len(index)) / len(rows) - RIDGE * w
        both = there[:, 1:]
        pair = np.exp(ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
        seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
        steps = (seen - np.where(both[:, :, None, None], pair, 0.0).sum((0, 1))).ravel()
        ends = [miss[:, 0].sum(), miss[np.arange(pages_n), size - 1].sum()]
        more = np.concatenate([steps, ends]) / len(rows) - RIDGE * extra
        for x, g, m, v in ((w, grad, slow[0], slow[1]), (extra, more, slow[2], slow[3])):  # Adam, in place
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model({f: float(w[i]) for f, i in index.items()}, extra[:4].reshape(2, 2), float(extra[4]), float(extra[5]))


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Null and empty pages have empty text; repeated rows are pages of their own;
    other columns are not looked at; no rows give no rows.
    """

    def run(batches):
        known = model.known
        for b in batches:
            texts = [model.text(h, known) for h in b["_html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("_html"))
    return base.mapInPandas(run, "page_id long, url string, text string, n_chars long")


@query("op12_html_text")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), fit(labelled_pages(PAGES)))
