"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks, trained on labelled sentences.

The kernel of two words counts their common subsequences of three characters (word ends included) whose gaps
are at most MAX_GAP wide, each gap weighing DECAY, over the product of both words' norms; an inserted or
dropped character therefore keeps most of a word's similarity. Labels are of documents: a toxic document's
sentences, and a toxic sentence's words, are bags of which only some members are toxic. So this is a multiple
instance machine: a sentence's score is that of its most toxic word, and the words that tell the labelled
sentences apart (by the documents of either label in whose sentences they stand) are the positive instances,
words of clean sentences the negative ones. A linear SVM (squared hinge) is trained on the instances' Nystroem features over
landmark words. As the features are linear in kernel values, the trained machine is folded into one weight per
subsequence, and a word is scored by summing table entries.

A document's probability is a logistic function of its worst sentences' scores and of how many words and
sentences are positive. One machine is trained without each fold, and the function is fitted on what these give
the folds that they had not seen; texts are scored by the mean of these machines (of their tables), so that the
function meets scores like those it was fitted on. Training and scoring cut texts into sentences and words alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered_by_keys, materialize, row_key, small_batches, tidy, trim, worker_cache
from .labelled import held_out, training_rows

#: Most labelled rows that a model is fitted on.
TRAIN_ROWS = 5000
THRESHOLD = 0.7
LENGTH, DECAY, MAX_GAP = 3, 0.55, 2
LANDMARKS = 128
POSITIVES, NEGATIVES, HARD = 500, 5000, 2000
#: Least evidence (twice a log likelihood ratio) that a word tells toxic sentences from clean ones.
SURE = 22.0
FOLDS = 4
#: Characters of a word in one row of codes; longer words have several rows, which overlap by what a subsequence spans.
WIDTH = 28
OVERLAP = 2 * (MAX_GAP + 1)
BITS = 18
#: Word scores that a worker keeps at most.
CACHE = 50_000
TOP = 5
WORD = re.compile(r"[^\W_]+")
SPREAD = re.compile(r"(?<![^\W_])[^\W\d_](?:[\W_]{1,2}[^\W\d_](?![^\W_])){2,}")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(sentence: str) -> list[str]:
    """Lower-cased words, and runs of single letters (s p r e a d, d.o.t.t.e.d) as words."""
    low = sentence.lower()
    words = WORD.findall(low)
    if any(len(w) == 1 for w in words):
        words += [re.sub(r"[\W_]+", "", m) for m in SPREAD.findall(low)]
    return words


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequence codes (rows, entries), their weights (0 where a word is over) and each row's word."""
    rows, owner = [], []
    for i, w in enumerate(words):
        full = f"^{w}$"
        for s in range(0, max(1, len(full) - OVERLAP), WIDTH - OVERLAP):
            rows.append(full[s : s + WIDTH])
            owner.append(i)
    chars = np.zeros((len(rows), WIDTH), np.uint64)
    for i, r in enumerate(rows):
        chars[i, : len(r)] = [ord(c) for c in r]
    return *_expand(chars), np.array(owner, np.int64)


def _expand(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, weights = [], []
    mask, m1, m2 = np.uint64((1 << BITS) - 1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    for a in range(1, MAX_GAP + 2):
        for b in range(1, MAX_GAP + 2):
            last = chars[:, a + b :]
            n = last.shape[1]
            code = (chars[:, :n] * m1 + chars[:, a : a + n]) * m2 + last
            code = code * m1
            codes.append(((code >> np.uint64(40)) & mask).astype(np.int32))
            weights.append(np.where(last > 0, np.float32(DECAY ** (a + b - 2)), np.float32(0)))
    return np.concatenate(codes, 1), np.concatenate(weights, 1)


def _fold(codes: np.ndarray, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.maximum((weights**2).sum(1), 1e-9))
    return (table[codes] * weights).sum(1) / norm


class WordMachine:
    """Score of a word: above 0 for words like those that tell toxic sentences apart."""

    def fit(self, bags: list[list[str]], y: np.ndarray) -> WordMachine:
        """bags: the distinct words of each document's sentences; y: its label."""
        self.table, self.bias = np.zeros(1 << BITS, np.float32), -1.0
        toxic, clean = Counter(), Counter()
        for bag, label in zip(bags, y, strict=True):
            (toxic if label else clean).update(bag)
        nt, nc = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
        odds = {w: np.log((c + 0.5) / (nt - c + 0.5)) - np.log((clean[w] + 0.5) / (nc - clean[w] + 0.5)) for w, c in toxic.items()}
        share = nt / (nt + nc)
        sure = {w: 2 * c * np.log(c / (c + clean[w]) / share) for w, c in toxic.items()}  # evidence beyond chance
        positive = sorted((w for w, c in toxic.items() if c >= 3 and odds[w] > 2.2 and sure[w] > SURE and len(w) > 2), key=lambda w: (-sure[w], w))[:POSITIVES]
        chosen = set(positive)
        self.positive = positive
        neutral = sorted((w for w in clean if w not in chosen and (toxic[w] == 0 or odds[w] < 0.7)), key=lambda w: (-clean[w], w))
        rest = neutral[NEGATIVES // 2 :]
        negative = neutral[: NEGATIVES // 2] + rest[:: max(1, len(rest) // (NEGATIVES // 2))]
        if not positive or not negative:
            return self
        worth = np.sqrt([sure[w] / SURE for w in positive])
        self._train(positive, worth, negative)
        mined = np.argsort(-self.score(neutral), kind="stable")[:HARD]  # clean words that look toxic
        self._train(positive, worth, list(dict.fromkeys([*negative, *(neutral[i] for i in mined)])))
        return self

    def _train(self, positive: list[str], worth: np.ndarray, negative: list[str]) -> None:
        words = positive + negative
        target = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        codes, weights, owner = _codes(words)  # a long word's rows are instances each: it scores as its best one
        target, worth = target[owner], np.concatenate([worth, np.full(len(negative), 0.25)])[owner]
        ahead = np.flatnonzero(target > 0)
        norm = np.sqrt(np.maximum((weights**2).sum(1), 1e-9))

        def kernel(marks: np.ndarray) -> np.ndarray:
            out = np.empty((len(owner), len(marks)), np.float32)
            for j, m in enumerate(marks):
                t = np.zeros(1 << BITS, np.float32)
                np.add.at(t, codes[m], weights[m] / norm[m])
                out[:, j] = (t[codes] * weights).sum(1) / norm
            return out

        best = ahead[: LANDMARKS // 2]
        close = kernel(best).max(1)
        close[ahead] = -1
        marks = np.concatenate([best, np.argsort(-close, kind="stable")[: LANDMARKS - len(best)]])
        k = kernel(marks).astype(float)
        values, vectors = np.linalg.eigh((k[marks] + k[marks].T) / 2)
        keep = values > 1e-4 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        z = np.concatenate([k @ root, np.ones((len(owner), 1))], 1)
        cost = 4.0 * worth
        w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], 0.3)
        ridge[-1] = 1e-3
        for _ in range(25):  # Newton steps on the squared hinge
            active = target * (z @ w) < 1
            za, ca = z[active], cost[active]
            step = np.linalg.solve((za * ca[:, None]).T @ za + np.diag(ridge), (za * ca[:, None]).T @ target[active])
            if np.abs(step - w).max() < 1e-6:
                break
            w = step
        beta = root @ w[:-1]
        table = np.zeros(1 << BITS)
        for m, b in zip(marks, beta, strict=True):
            np.add.at(table, codes[m], b * weights[m] / norm[m])
        self.table, self.bias = table.astype(np.float32), float(w[-1])

    def score(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0, np.float32)
        out = np.full(len(words), -9.0, np.float32)
        for s in range(0, len(words), 4096):
            codes, weights, owner = _codes(words[s : s + 4096])
            np.maximum.at(out, owner + s, _fold(codes, weights, self.table) + np.float32(self.bias))
        return out


def figures_of(sentences: list[list[str]], score) -> list[float]:
    """What the document's logistic function sees: its sentences' scores, and what share of its words is positive.

    Sentences whose worst words are the same count once among the scores, as a repeated line says nothing more.
    """
    if not sentences:
        return [*[-2.0] * TOP, 0.0, 0.0, 0.0, 0.0, 0.0]
    each = np.fromiter((score(w) for s in sentences for w in s), np.float32)
    scores = np.maximum.reduceat(each, np.cumsum([0, *map(len, sentences[:-1])]))
    top = np.unique(scores)[: -TOP - 1 : -1]
    top = np.concatenate([top, np.full(TOP - len(top), -2.0)]).clip(-2, 2)
    words = {w for s in sentences for w in s}
    toxic = [x for w in words if (x := score(w)) > 0] if top[0] > 0 else []
    return [*top, np.log1p(len(toxic)), np.log1p(sum(x > 0.5 for x in toxic)), len(toxic) / len(words), np.log(len(words)), (scores > 0).mean()]


class ToxicityModel:
    def fit(self, docs: list[list[list[str]]], y: np.ndarray) -> ToxicityModel:
        """docs: the sentences of each document, as words; y: its label."""
        bags = [list(dict.fromkeys(w for s in d for w in s)) for d in docs]
        fold = np.arange(len(docs)) % FOLDS
        x = np.zeros((len(docs), TOP + 5))
        machines = []
        for k in range(FOLDS):
            machine = WordMachine().fit([b for b, f in zip(bags, fold, strict=True) if f != k], y[fold != k])
            machines.append(machine)
            own = np.flatnonzero(fold == k)
            words = list(dict.fromkeys(w for i in own for w in bags[i]))
            known = dict(zip(words, machine.score(words).tolist(), strict=True))
            for i in own:
                x[i] = figures_of(docs[i], known.__getitem__)
        self.machine = WordMachine()
        self.machine.table = np.mean([m.table for m in machines], 0, dtype=np.float32)
        self.machine.bias = float(np.mean([m.bias for m in machines]))
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(TOP + 5), np.ones(TOP + 5))
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], 1)
        w = np.zeros(z.shape[1])
        w[-1] = -4.0 if not y.any() else 0.0
        for _ in range(30 if y.any() and not y.all() else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag([1.0] * (len(w) - 1) + [1e-3])
            g = z.T @ (p - y) + np.array([1.0] * (len(w) - 1) + [1e-3]) * w
            w -= np.linalg.solve(h, g)
        self.weights = w
        return self

    def probability(self, figures: np.ndarray) -> np.ndarray:
        z = (figures - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence that has any."""
    return [words for s in SENTENCE.split(text) if (words := words_of(s))]


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Model fitted on the sentences of at most `rows` labelled rows outside the held-out fold."""

    def task(batches):
        for b in batches:
            found = [sentences_of(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.list_(pa.string())))], ["d_id", "label", "sentences"])

    with small_batches(docs.sparkSession):
        found = training_rows(docs, labels, "toxic", rows).mapInArrow(task, "d_id long, label int, sentences array<array<string>>").toArrow()
    known: dict[str, str] = {}  # each word is held once
    one = known.setdefault
    made = [(i, y, [[one(w, w) for w in s] for s in d.as_py()]) for i, y, d in zip(*(found.column(c).to_pylist() if c < 2 else found.column(c) for c in range(3)), strict=True)]
    del found
    made.sort()
    model = ToxicityModel().fit([d for _, _, d in made], np.array([y for _, y, _ in made], float))
    del made, known, one
    trim()  # the driver keeps only the model through the stages after this one
    return model


def _score_batches(batches: Iterator[pa.RecordBatch], model: ToxicityModel, known: dict[str, float], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The first two columns, under `names`, with the score of the third, a text."""
    worker_cache("toxicity", known)
    for b in batches:
        for s in range(0, b.num_rows, 256):
            part = b.slice(s, 256)
            docs = [sentences_of(t.as_py() or "") for t in part.column(2)]
            words = {w for d in docs for x in d for w in x}
            new = [w for w in words if w not in known]
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(words)
            known.update(zip(new, model.machine.score(new).tolist(), strict=True))
            figures = np.array([figures_of(d, known.__getitem__) for d in docs], float)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.probability(figures))], [*names, "score"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (probability of label 1), predicted.

    Null and empty texts are scored as texts without words. Without usable labels all scores are low.
    Repeated rows each get a row, null ids are not held out. An empty table gives an empty result. Other
    columns are not read.
    """

    def task(batches):
        yield from tidy(_score_batches(batches, model, {}, ["doc_id", "held_out"]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(task, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without its toxic rows, in its own columns; Python sees keys and texts, and hands back rejected keys alone.

    Null and empty texts are judged as texts without words; rows repeated in id and text go or stay together; an empty
    table stays empty.
    """

    def task(batches):
        yield from tidy(_score_batches(batches, model, {}, ["k_id", "k_hash"]))

    key = ["k_id", "k_hash"]
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        scored = rows.mapInArrow(task, "k_id string, k_hash long, score double")
        bad = materialize(scored.filter(F.col("score") >= threshold).select(*key).distinct(), "toxic")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(id_col, text_col))
    return filtered_by_keys(keyed, bad, key, "left_anti").select("row.*")
