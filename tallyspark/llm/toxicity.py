"""Toxicity: a support vector machine with a subsequence string kernel, Nystroem landmarks, over the words of sentences.

Kernel: a word (with a start mark) is the set of its three-character subsequences, gaps allowed up to a span of SPAN
steps; a subsequence weighs DECAY to the number of characters it skips, and the kernel is the normalised product. So
'idiot', 'id-iot' and 'idxiot' share most of their weight. Runs of three or more one-character tokens ('i d i o t')
are read as one word.

Training is multiple-instance: a labelled text is toxic if its worst word is. Landmarks are words that cover the toxic
training texts, and words of the others; a squared-hinge SVM in the Nystroem space is refitted with each toxic text's
worst words and with the hardest words of the clean ones. The trained machine folds into one weight for each
subsequence, so a new word costs a few table look-ups a character and each distinct word is scored once a worker.

A text's score takes in all its words, each occurrence on its own: a logistic function of the four largest decision
values, of the log of the sum of all values over FLOOR for a word, and of the number of words. It is taken of the
whole text and of overlapping passages of PASSAGE words, and the largest of these counts, so a long text does not hide
a passage.

Training rows: at most `max_docs` labelled texts and `max_bytes` of them, chosen by a hash of their id; each toxic one among them gives the
machine words to learn from. Scoring covers every text whole.
Defined cases: a null text is empty; a text without words scores 0; without labels of both
kinds no machine can be fitted and every score is 0; rows with equal ids are scored alike by their texts.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session

SPAN, DECAY = 5, 0.7
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN + 1 - a)]
MAX_DOCS, MAX_BYTES, LANDMARKS, NEGATIVES = 4_000, 64 << 20, 96, 3_000
FLOOR, SURE = -0.6, 1.4
#: Words whose subsequences are laid out together.
MANY = 20_000
#: Words of a passage; one starts at every half of it.
PASSAGE = 200
TOP = 4
#: Weights by which every score is 0.
NEVER = np.array([-30.0] + [0.0] * (TOP + 2))
END, START, OTHER = 63, 1, 62
SIGNS = string.punctuation + "«»“”„’‘…"

CODES = np.full(1 << 16, OTHER, np.uint8)
for _i in range(1 << 16):
    if 97 <= _i <= 122:
        CODES[_i] = _i - 95
    elif _i > 127 and chr(_i).isalpha():
        CODES[_i] = 28 + _i % 34
CODES[0], CODES[2] = END, START
#: Words may hold the two characters that mark their ends here.
MARKS = {0: 1, 2: 1}


def tokens(text: str | None) -> list[str]:
    """Lower-cased words; a run of three or more one-character tokens is one word."""
    words = (text or "").lower().split()
    if sum(len(w) == 1 for w in words) >= 3:
        out, run = [], []
        for w in [*words, ""]:
            if len(w) == 1:
                run.append(w)
            else:
                out += ["".join(run)] if len(run) >= 3 else run
                run = []
                out.append(w)
        words = out[:-1]
    return words


class Occurrences:
    """The subsequences of a list of words, with gaps: word number, code and weight, a gap pattern at a time."""

    def __init__(self, words: list[str]):
        flat = "".join(f"\0\2{w.strip(SIGNS).translate(MARKS)}" for w in words) + "\0"
        raw = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32)
        self.codes = CODES[np.minimum(raw, (1 << 16) - 1)].astype(np.int32)
        self.n, self.word = len(words), np.cumsum(self.codes == END) - 1

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        for a, b in GAPS:
            if len(self.codes) > a + b:
                first, last = self.codes[: -a - b], self.codes[a + b :]
                ok = (self.word[: -a - b] == self.word[a + b :]) & (first != END)
                yield self.word[: -a - b][ok], ((first << 12) | (self.codes[a:-b] << 6) | last)[ok], DECAY ** (a + b - 2)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Of each word, the weighted sum of a value for each subsequence."""
        out = np.zeros(self.n)
        for word, code, w in self:
            out += np.bincount(word, table[code] * w, self.n)
        return out

    def grouped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, code, weight) of the distinct subsequences."""
        parts = [(word.astype(np.int64) << 18 | code, np.full(len(code), w)) for word, code, w in self]
        key, weight = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ((), ())))
        key, at = np.unique(key, return_inverse=True)
        return key >> 18, key & ((1 << 18) - 1), np.bincount(at, weight, len(key))

    def norms(self) -> np.ndarray:
        word, _, weight = self.grouped()
        return np.sqrt(np.maximum(np.bincount(word, weight**2, self.n), 1e-12))

    def least_norms(self) -> np.ndarray:
        """A lower bound of norms(), without sorting: as if no subsequence occurred twice."""
        out = np.zeros(self.n)
        for word, _, w in self:
            out += np.bincount(word, None, self.n) * w * w
        return np.sqrt(np.maximum(out, 1e-12))


def evidence(values: np.ndarray) -> np.ndarray:
    """Of the decision values of a text's words in order, a row for the whole text and for each passage: the TOP largest
    values over FLOOR, the log of ten times their sum for a word (of 20 words more), a third of the log of the length."""
    v = np.minimum(values, SURE) - FLOOR
    n, step = len(v), PASSAGE // 2
    sizes, parts = np.array([n]), [np.pad(v, (0, max(0, TOP - n)))[None]]
    if n > PASSAGE:
        k = -(-(n - PASSAGE) // step) + 1
        parts.append(sliding_window_view(np.pad(v, (0, (k - 1) * step + PASSAGE - n)), PASSAGE)[::step])
        sizes = np.array([n] + [PASSAGE] * (k - 1) + [n - (k - 1) * step])
        if not v.any():
            sizes, parts[1] = sizes[[0, 1, -1]], parts[1][[0, -1]]  # the passages between are alike
    top = np.concatenate([np.sort(np.partition(p, p.shape[1] - TOP)[:, -TOP:])[:, ::-1] for p in parts])
    total = np.concatenate([p.sum(1) for p in parts])
    return np.column_stack([top, np.log1p(10 * total / (sizes + 20)), np.log1p(sizes) / 3])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Machine:
    """The folded machine: a weight for each subsequence, a bias, and the weights (bias first) of a text's evidence."""

    def __init__(self, table: np.ndarray, bias: float, logit: np.ndarray, most: int = 400_000):
        self.table, self.bias, self.logit, self.most = table.astype(np.float32), bias, logit, most
        self.seen: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def of_words(self, words: list[str]) -> np.ndarray:
        """Decision values, FLOOR at least; the norm is only computed where the value can exceed FLOOR."""
        if len(words) > MANY:
            return np.concatenate([self.of_words(words[i : i + MANY]) for i in range(0, len(words), MANY)])
        occ = Occurrences(words)
        s = occ.sums(self.table)
        out = np.full(len(words), FLOOR)
        can = np.flatnonzero(np.where(s > 0, s / occ.least_norms(), 0) + self.bias > FLOOR)
        if len(can):
            norms = Occurrences([words[i] for i in can]).norms()
            out[can] = np.maximum(FLOOR, s[can] / norms + self.bias)
        return out

    def of_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The evidence of each text."""
        own = [tokens(t) for t in texts]
        new = list(set().union(*own).difference(self.seen))
        if len(self.seen) + len(new) > self.most:
            self.seen.clear()
            new = list(set().union(*own))
        for i in range(0, len(new), MANY):
            self.seen.update(zip(new[i : i + MANY], self.of_words(new[i : i + MANY]).tolist(), strict=True))
        get = self.seen.__getitem__
        return [evidence(np.fromiter(map(get, words), float, len(words))) for words in own]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = self.of_texts(texts)
        if not found:
            return np.zeros(0)
        first = np.cumsum([0] + [len(x) for x in found[:-1]])
        best = np.maximum.reduceat(self.logit[0] + np.concatenate(found) @ self.logit[1:], first)
        return np.where([x[0, -1] > 0 for x in found], sigmoid(best), 0.0)


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, l2: float = 0.01) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), l2 * np.eye(x.shape[1])
    for _ in range(30):
        on = y * (x @ w) < 1
        xs = x[on] * cost[on, None]
        new = np.linalg.solve(xs.T @ x[on] + ridge, xs.T @ y[on])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), l2 * np.diag([1e-3] + [1] * (x.shape[1] - 1))
    for _ in range(60):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge @ w), -4, 4)
    return w


def calibrated(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights of the evidence: learned from whole texts, then from the part of each text that these put highest."""
    w = logistic(np.array([x[0] for x in found]), y)
    return logistic(np.array([x[np.argmax(x @ w[1:])] for x in found]), y)


def kernel_to(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel values (words, marks)."""
    mw, mc, mv = Occurrences(marks).grouped()
    codes, at = np.unique(mc, return_inverse=True)
    t = np.zeros((len(codes), len(marks)), np.float32)
    t[at, mw] = mv / Occurrences(marks).norms()[mw]
    out = []
    for i in range(0, len(words), 2_000):
        occ = Occurrences(words[i : i + 2_000])
        w, c, v = occ.grouped()
        norm = np.sqrt(np.maximum(np.bincount(w, v**2, occ.n), 1e-12))
        j = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        hit = codes[j] == c
        dense = np.zeros((occ.n, len(codes)), np.float32)
        dense[w[hit], j[hit]] = v[hit] / norm[w[hit]]
        out.append(dense @ t)
    return np.concatenate(out)


def covering(bags: list[set[str]], clean: Counter, n_clean: int, many: int) -> list[str]:
    """Words that are in many of the bags and in few clean texts; a bag that is covered counts less for the next."""
    inside = defaultdict(list)
    for i, bag in enumerate(bags):
        for w in bag:
            inside[w].append(i)
    usual = lambda w: (clean[w] + 0.5) / (n_clean + 1) * len(bags)
    sure = {w for w, own in inside.items() if len(own) > max(5 * usual(w), usual(w) + 3 * math.sqrt(usual(w) + 1))}
    inside = {w: np.array(own) for w, own in inside.items() if w in sure or not sure and len(own) > 5 * usual(w)}
    worth, marks = np.ones(len(bags)), []
    while inside and len(marks) < many:
        best = max(inside, key=lambda w: (worth[inside[w]].sum() * math.log((1 + len(inside[w])) / (1 + clean[w])), w))
        marks.append(best)
        worth[inside.pop(best)] *= 0.5
    return marks


def trained(rows: list[tuple[str | None, int]], landmarks: int = LANDMARKS, negatives: int = NEGATIVES, rounds: int = 5) -> Machine:
    """A machine from (text, toxic) rows."""
    rng = np.random.default_rng(3)
    own = [{w.strip(SIGNS) for w in tokens(t)} - {""} for t, _ in rows]
    y = np.array([int(toxic) for _, toxic in rows])
    bad, good = [own[i] for i in np.flatnonzero(y == 1)], [own[i] for i in np.flatnonzero(y == 0)]
    if not any(bad) or not any(good):
        return Machine(np.zeros(1 << 18), FLOOR, NEVER)
    clean, n_good = Counter(w for bag in good for w in bag), len(good)
    del own, good
    marks = covering(bad, clean, n_good, landmarks)
    pool = sorted(clean)
    some = [pool[i] for i in rng.permutation(len(pool))[: max(landmarks // 2, 8)]]
    marks = list(dict.fromkeys(marks + some))
    mm = kernel_to(marks, marks).astype(float)
    value, vector = np.linalg.eigh(mm + 1e-3 * np.eye(len(marks)))
    root = vector / np.sqrt(value) @ vector.T
    # the machine sees words; a toxic text's first worst word is its nearest to a covering landmark
    n_bad = len(marks) - len(some)
    words_of_bad = [sorted(b - clean.keys()) or sorted(b) for b in bad]
    flat = sorted(set().union(*words_of_bad))
    number = {w: i for i, w in enumerate(flat)}
    near = kernel_to(flat, marks[: max(1, n_bad)]).max(1)
    value_of = near
    hard = [pool[i] for i in rng.permutation(len(pool))[:negatives]]
    # spellings with a character put in: the machine shall hold them for what they are
    spelt = [w[:i] + c + w[i:] for w in marks[:n_bad] if len(w) >= 4 for i, c in zip(rng.integers(1, len(w), 2).tolist(), ("-", "x"), strict=True)]
    machine = None
    for k in range(rounds):
        worst = []
        for ws in words_of_bad:
            ranked = sorted(ws, key=lambda w: -value_of[number[w]])
            worst += [w for w in ranked[:2] if k == 0 or value_of[number[w]] > FLOOR / 2] or ranked[:1]
        if not worst:
            break
        x = kernel_to(worst + spelt + hard, marks) @ root
        label = np.array([1.0] * (len(worst) + len(spelt)) + [-1.0] * len(hard))
        share = np.array([1.0] * len(worst) + [0.15 * len(worst) / max(1, len(spelt))] * len(spelt) + [4 * len(worst) / len(hard)] * len(hard))
        w = svm(x, label, share)
        alpha = root @ w[:-1]
        table = np.zeros(1 << 18)
        mw, mc, mv = Occurrences(marks).grouped()
        np.add.at(table, mc, alpha[mw] * mv / Occurrences(marks).norms()[mw])
        machine = Machine(table, float(w[-1]), NEVER)
        value_of = machine.of_words(flat)
        of_pool = machine.of_words(pool)
        hard = list(dict.fromkeys(hard + [pool[i] for i in np.argsort(-of_pool)[: negatives // 2]]))
    if machine is None:
        return Machine(np.zeros(1 << 18), FLOOR, NEVER)
    found = []
    for i in range(0, len(rows), 256):
        found += machine.of_texts([t for t, _ in rows[i : i + 256]])
    machine.logit = calibrated(found, y)
    return machine


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> list[tuple[str | None, int]]:
    """At most max_docs labelled texts, whole, and max_bytes of them together, in order of a hash of their id."""
    ids = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).distinct()
    few = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_docs)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(few), "doc_id").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    rows = rows.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id", "toxic", "text").limit(max_docs)
    so_far = F.sum("size").over(Window.orderBy("order", "doc_id", "toxic", "text").rowsBetween(Window.unboundedPreceding, 0))  # over max_docs rows
    kept = rows.withColumn("so_far", so_far).filter(F.col("so_far") <= max_bytes).select("text", "toxic", "doc_id").collect()
    return [(r[0], r[1]) for r in sorted(kept, key=lambda r: (r[2], r[0] or "", r[1]))]


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and score."""
    session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(machine.scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """docs (any columns, among them text) without the texts that score `least` or more."""
    session(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(machine.scores(b.column(at).to_pylist()) < least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
