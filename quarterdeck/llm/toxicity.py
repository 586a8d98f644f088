r"""Toxicity of whole texts after noisy-channel deobfuscation.

1. A character trigram model over a fixed alphabet is counted over all documents (per
   task as a dense table, then summed by trigram; the table has ``SYMBOLS**3`` cells).
2. A token with digits or signs inside, with a letter three or more times in a row or with several doubled ones, and
   a run of three or more spaced single characters become a lattice: each character may
   be itself, a letter it resembles (``LOOKS_LIKE``), nothing (a separator between
   letters) or, for a separator, a word end; a run of one letter is emitted once or
   twice. Viterbi decoding finds the path of the highest language-model probability less
   channel costs. A token without any letter may also be meant as it stands, a number, at a cost of its
   own (``DIGIT``, ``MARK``); the cheaper reading wins. Other tokens have one path and stay as they are.
3. Restored words give presence features: the word and its prefixes of 3 to 6 letters.
   Among the labelled rows that may be learned from, one half (by text hash) selects the
   features that are far likelier in toxic texts; the other half fits a logistic score on
   their summed and largest weights and their number. Labels come from a bounded sample
   of about ``TRAIN_ROWS`` rows drawn by a hash.

Scoring is a map over whole texts; tasks receive the trigram table and the selected
features, both of bounded size. Decoded tokens are kept per worker up to a bound.

Defined results: null and empty texts, and all rows if there are no labels of either
kind, get the score of a text without features. Several labels for one id: toxic if any
says so; null labels are ignored. Repeated rows give repeated rows; an empty table gives
no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import save_stage
from .common import held_out, small_side

# Letters of the model's alphabet, and what signs may stand for.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiou", "#": "h",
}
SYMBOLS = 64  # 0: word end, 1: any other letter, then the alphabet
_CODE = {c: i + 2 for i, c in enumerate(ALPHABET)}
_CODES = np.array([_CODE.get(chr(c), 1 if chr(c).isalpha() else 0) for c in range(1 << 16)], dtype=np.int32)

#: channel costs, in nats
SWAP, DROP, SPLIT, SIGN, SINGLE = 1.0, 0.7, 1.0, 9.0, 3.0
#: stands between spaced characters; it may be dropped or end a word
SEPARATOR = "\u200b"
#: cost of a digit or a sign that is meant as it stands, in a token without letters
DIGIT, MARK = 2.3, 6.0
#: readings of longer tokens are not kept
KEPT_LENGTH = 64
TRAIN_ROWS = 40_000
LEAST_TOXIC, LEAST_Z, FEATURES = 3, 3.0, 4096
THRESHOLD = 0.7
KEPT_TOKENS = 400_000
_THRICE = re.compile(r"(.)\1\1|(.)\2.*(.)\3")  # or two doubled letters
_SPACED = re.compile(r"(?<=\s)\S(?:[ \t]+\S(?!\S)){2,}|\A\S(?:[ \t]+\S(?!\S)){2,}")
_RUN = re.compile(r"(.)\1*")


def trigram_counts(docs: DataFrame) -> DataFrame:
    """cell, n: trigrams of the lower-cased texts of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                text = " ".join([t or "" for t in batch.column(0).slice(at, 64).to_pylist()]).lower()
                codes = _CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)]
                if len(codes) > 2:
                    codes = codes[np.append(True, (codes[1:] > 0) | (codes[:-1] > 0))]  # one word end between words
                    total += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS ** 3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], ["cell", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def language_model(counts: list[tuple[int, int]]) -> np.ndarray:
    """Interpolated log probabilities [a, b, c] of c after a, b."""
    n = np.zeros(SYMBOLS ** 3)
    for cell, count in counts:
        n[cell] = count
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs, ones = n.sum(axis=0), n.sum(axis=(0, 1))
    p1 = (ones + 1) / (ones.sum() + SYMBOLS)
    p2 = (pairs + 5 * p1) / (pairs.sum(axis=1, keepdims=True) + 5)
    p3 = (n + 5 * p2[None]) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


class Restorer:
    """Decodes tokens under the language model."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs.tolist()

    def choices(self, char: str, repeats: int) -> list[tuple[str, float]]:
        """What a run of one character may stand for, with channel costs."""
        if char.isalpha():
            return [(char, 0.0), (char, SINGLE), (char, DROP)][min(repeats, 3) - 1:min(repeats, 3)] + [(char * 2, 0.0 if repeats == 2 else DROP)] * (repeats > 1)
        out = [(letter, SWAP) for letter in LOOKS_LIKE.get(char, "")]
        if repeats > 1:
            out += [(letter * 2, SWAP) for letter, _ in out]
        return out + [("", DROP if not char.isdigit() else SIGN), (" ", SPLIT)]

    def decode(self, token: str) -> str:
        """The likeliest reading, words separated by spaces; nothing if a token without letters stands for itself."""
        logs, settled = self.logs, []
        states: dict = {(0, 0): (0.0, None)}  # score, and the letters so far as a chain that readings share
        for run in _RUN.finditer(token):
            best: dict = {}
            for emitted, cost in self.choices(run[1], run.end() - run.start()):
                for (a, b), (score, text) in states.items():
                    value, x, y, shown = score - cost, a, b, emitted
                    for char in emitted:
                        c = _CODE.get(char, 0 if char == " " else 1)
                        if c == 0 and y == 0:  # a word end after a word end says nothing
                            shown = ""
                            continue
                        value += logs[x][y][c]
                        x, y = y, c
                    old = best.get((x, y))
                    if old is None or value > old[0]:
                        best[(x, y)] = (value, (text, shown) if shown else text)
            states = best
            if len(states) == 1:  # all readings share what is before
                (state, (score, text)), = states.items()
                settled.append(_spelled(text))
                states = {state: (score, None)}
        ((a, b), (score, last)) = max(states.items(), key=lambda s: s[1][0] + logs[s[0][0]][s[0][1]][0])
        if not any(c.isalpha() for c in token) and score + logs[a][b][0] <= -sum(DIGIT if c.isdigit() else MARK for c in token if c != SEPARATOR):
            return ""
        return "".join(settled) + _spelled(last)


def _spelled(chain: tuple | None) -> str:
    parts = []
    while chain is not None:
        chain, shown = chain
        parts.append(shown)
    return "".join(reversed(parts))


class Words:
    """Restored words and their features, kept for distinct tokens up to a bound.

    ``kept`` has the features of tokens, ``nothing`` the tokens without any.
    """

    def __init__(self, logs: np.ndarray, weights: dict[str, float] | None = None):
        self.restorer, self.weights, self.kept, self.nothing = Restorer(logs), weights, {}, set()
        self.heads = None if weights is None else {name.rstrip("$")[:3] for name in weights}

    def restored(self, token: str) -> list[str]:
        bare = token.strip(".,;:?\"'()[]{}<>&%#*~`^_=/\\-")
        if bare.isalpha() and not _THRICE.search(bare):
            return [bare]
        bare = token.strip(".,;:?\"'%&#~`^_=/\\-<>[]{}")
        return self.restorer.decode(bare).split()

    def features(self, token: str) -> set[str]:
        names = set()
        for word in self.restored(token):
            if self.heads is None or word[:3] in self.heads:
                names.add(f"{word}$" if len(word) < 40 else word[:40])
                names.update(word[:n] for n in range(3, 1 + min(6, len(word))))
        return names if self.weights is None else {name for name in names if name in self.weights}

    def of(self, text: str) -> set[str]:
        """Distinct features of a whole text."""
        text = text.lower()
        tokens = set(text.split())
        for span in _SPACED.findall(text) if _SPACED.search(text) else ():
            tokens.add(SEPARATOR.join(span.split()))
        if len(self.nothing) + len(self.kept) > KEPT_TOKENS:
            self.kept, self.nothing = {}, set()
        tokens.difference_update(self.nothing)
        names: set[str] = set()
        for token in tokens:
            found = self.kept.get(token)
            if found is None:
                found = self.features(token)
                if len(token) > KEPT_LENGTH:
                    pass
                elif found:
                    self.kept[token] = found
                else:
                    self.nothing.add(token)
            names.update(found)
        return names


def summary(names: set[str], weights: dict[str, float]) -> tuple[float, float, float]:
    """Summed and largest weight, and number of words' worth, of the features present."""
    found = [weights[name] for name in names if name in weights]
    return (min(sum(found), 60.0) / 10, max(found, default=0.0) / 5, math.log1p(len(found)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, y, half of the bounded sample that may be learned from."""
    truth = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    truth = truth.filter(~held_out(F.col("doc_id")))
    share = min(1.0, TRAIN_ROWS / max(1, truth.count()))
    # labels are drawn before the join, so the joined side is bounded and texts need not move
    drawn = save_stage(truth.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), "toxicity-labels")
    rows = docs.select("doc_id", "text").filter("text is not null and doc_id is not null").join(small_side(drawn, 16), "doc_id")
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")  # copies stay in one half
    return save_stage(rows.select("doc_id", "text", F.col("y").cast("int").alias("y"), half.alias("half")), "toxicity-sample")


def _feature_counts(rows: DataFrame, logs) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(logs.value)
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if y else clean).update(words.of(text))
            if len(toxic) + len(clean) > 1_000_000:
                yield told(toxic, clean)
        yield told(toxic, clean)

    def told(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        names = list(set(toxic) | set(clean))
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], ["name", "a", "b"])
        toxic.clear(), clean.clear()
        return out

    counts = rows.select("text", "y").mapInArrow(run, "name string, a long, b long")
    return counts.groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _summaries(rows: DataFrame, logs, weights, extra: str) -> DataFrame:
    """``extra`` column and the three summary values of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(logs.value, weights.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = np.array([summary(words.of(text or ""), weights.value) for text in part.column(1).to_pylist()]).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[:, k]) for k in range(3))], ["key", "total", "largest", "number"])

    return rows.select(F.col(extra).cast("long").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, total double, largest double, number double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``."""
    context = docs.sparkSession.sparkContext
    logs = context.broadcast(language_model([(r["cell"], r["n"]) for r in trigram_counts(docs).collect()]))  # at most SYMBOLS**3 cells
    rows = labelled(docs, labels)
    sizes = {(r["y"] > 0, r["half"]): r["n"] for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get((True, 0), 0), sizes.get((False, 0), 0)
    weights, fitted = {}, np.array([-4.0, 0, 0, 0])
    if n1 and n0:
        a, b = F.col("a") + 0.5, F.col("b") + 0.5
        odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
        z = odds / F.sqrt(1 / a + 1 / (n1 + 1 - a) + 1 / b + 1 / (n0 + 1 - b))
        best = _feature_counts(rows.filter("half = 0"), logs).filter(F.col("a") >= LEAST_TOXIC).select("name", odds.alias("odds"), z.alias("z"))
        weights = {r["name"]: r["odds"] for r in best.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "name").limit(FEATURES).collect()}
    weights = context.broadcast(weights)
    if weights.value and sizes.get((True, 1), 0) and sizes.get((False, 1), 0):
        seen = _summaries(rows.filter("half = 1"), logs, weights, "y").collect()  # bounded by TRAIN_ROWS
        seen.sort()
        fitted = _logistic(np.array([[r["total"], r["largest"], r["number"]] for r in seen]), np.array([float(r["key"] > 0) for r in seen]))
    w0, w1, w2, w3 = (float(w) for w in fitted)
    chance = 1 / (1 + F.exp(-(w0 + F.col("total") * w1 + F.col("largest") * w2 + F.col("number") * w3)))
    scored = _summaries(docs, logs, weights, "doc_id").select(F.col("key").alias("doc_id"), chance.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
