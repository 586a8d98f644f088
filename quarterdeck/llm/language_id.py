"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; every run of characters that are no letters stands as a word end.
Its character 2-, 3- and 4-grams inside words (word ends included) are hashed into
``BUCKETS`` rows of an embedding table; the mean row goes through a linear softmax. Table
and softmax are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows: per language about ``TRAIN_ROWS`` rows, drawn by a hash (fewer if
there are so many languages that ``MOST_ROWS`` would be passed); of a text of more than
``TRAIN_CHARS`` characters, a passage of that length from a place chosen by a hash. Every
language with a labelled row can be drawn. A fifth of the sample calibrates: a temperature
that minimises its log loss, and the score below which a prediction is rejected, chosen
so that at most ``LOST`` of its right predictions are lost.

Prediction is a map over whole texts. As the softmax is linear, table and weights are
folded into one logit row per bucket, which is all that the tasks receive (its size is
fixed by BUCKETS and the number of languages).

Defined results: texts that are null or have no letter get ``und``, score 0, rejected;
so does every row if no labelled row exists. Null languages and null texts never train.
Repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..session import save_stage
from .common import held_out, small_side

BUCKETS, DIMENSIONS = 1 << 16, 12
#: about so many training rows of a language, each a passage of at most so many characters, and of all languages together
TRAIN_ROWS, TRAIN_CHARS, MOST_ROWS = 1000, 20_000, 20_000
EPOCHS, RATE, BATCH = 4, 0.5, 16
LOST = 0.001
#: characters whose grams are held in memory at once
PIECE = 1 << 15
UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with a space for every character that is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(codes, 0xFFFF)
    fine = _LETTER[low]
    high = codes > 0xFFFF
    if high.any():
        fine = fine.copy()
        fine[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    return np.where(fine, codes, 32).astype(np.uint32)


def grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: start positions and buckets."""
    wide = codes.astype(np.uint64)
    space = codes == 32
    hashed = wide * _MULTIPLIERS[0]
    inner = None  # no space strictly inside
    for n in (2, 3, 4):
        if len(codes) < n:
            return
        hashed = hashed[:-1] + wide[n - 1:] * _MULTIPLIERS[n - 1]
        ends = space[:len(codes) - n + 1]
        if n == 2:
            use = ~(ends & space[1:])
        else:
            inner = ~space[1:-1] if n == 3 else inner[:-1] & ~space[2:-1]
            use = inner
        mixed = hashed ^ (hashed >> np.uint64(29))
        at = np.flatnonzero(use)
        yield at, ((mixed[at] * _MULTIPLIERS[0]) >> np.uint64(48)).astype(np.int64)


def pooled(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table rows of all grams of each text, and the number of grams."""
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), dtype=np.int64)

    def add(codes: np.ndarray, starts: np.ndarray, owners: np.ndarray, until: int) -> None:
        for at, bucket in grams(codes):
            keep = np.searchsorted(at, until)
            at, bucket = at[:keep], bucket[:keep]
            cuts = np.searchsorted(at, starts)
            n = np.diff(cuts, append=len(at))
            some = n > 0
            if some.any():
                sums[owners[some]] += np.add.reduceat(table[bucket], cuts[some], axis=0)
                counts[owners] += n

    held, lengths, owners = [], [], []

    def flush() -> None:
        if held:
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            joined = np.concatenate(held)
            add(joined, starts, np.array(owners), len(joined))
            held.clear(), lengths.clear(), owners.clear()

    for i, text in enumerate(texts):
        codes = np.concatenate([[np.uint32(32)], letters(text), np.full(4, 32, dtype=np.uint32)]).astype(np.uint32)
        if len(codes) <= PIECE:
            held.append(codes)
            lengths.append(len(codes))
            owners.append(i)
            if sum(lengths) > PIECE:
                flush()
        else:
            for begin in range(0, len(codes), PIECE):
                add(codes[begin:begin + PIECE + 3], np.array([0]), np.array([i]), PIECE)
    flush()
    return sums, counts


def bags(texts: Iterable[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares; texts are not kept."""
    out = []
    for text in texts:
        found = [bucket for _, bucket in grams(np.concatenate([[32], letters(text), [32] * 4]).astype(np.uint32))]
        bucket, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
        out.append((bucket.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    top = np.exp(logits - logits.max(axis=1, keepdims=True))
    return top / top.sum(axis=1, keepdims=True)


def train(texts: Iterable[str], langs: list[str], seed: int = 7) -> dict:
    """Folded logits per bucket, bias, languages, temperature and rejection score."""
    names = sorted(set(langs))
    truth = np.array([names.index(lang) for lang in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(langs))
    calibrate, fit = order[:len(langs) // 5], order[len(langs) // 5:]
    found = bags(texts)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    steps, total = 0, EPOCHS * max(1, len(fit))
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            rows = [i for i in fit[at:at + BATCH] if len(found[i][0])]
            if not rows:
                continue
            rate = RATE * (1 - steps / total)
            steps += len(rows)
            mean = np.stack([share @ table[bucket] for bucket, share in (found[i] for i in rows)])
            error = softmax(mean @ weights + bias)
            error[np.arange(len(rows)), truth[rows]] -= 1
            back = error @ weights.T
            weights -= rate * (mean.T @ error)
            bias -= rate * error.mean(axis=0)
            for i, step in zip(rows, back):  # buckets of one row are distinct; mean shares are tiny, so the table moves faster
                bucket, share = found[i]
                table[bucket] -= (rate * 50) * share[:, None] * step
    folded = (table @ weights).astype(np.float32)
    usable = [i for i in calibrate if len(found[i][0])]
    temperature, least = 1.0, 0.0
    if usable:
        logits = np.stack([share @ folded[bucket] for bucket, share in (found[i] for i in usable)]) + bias
        lossy = lambda t: -np.log(softmax(logits / t)[np.arange(len(usable)), truth[usable]] + 1e-12).mean()
        temperature = min((0.05 * 1.25 ** k for k in range(24)), key=lossy)
        chance = softmax(logits / temperature)
        right = chance.argmax(axis=1) == truth[usable]
        if right.any():
            least = min(float(np.quantile(chance.max(axis=1)[right], LOST)), 0.5)
    return {"names": names, "folded": folded, "bias": bias, "temperature": temperature, "least": least}


def learnable(docs: DataFrame) -> DataFrame:
    """The labelled sample that the model may see: each language's rows by a hash, at the share that gives TRAIN_ROWS."""
    rows = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    counts = save_stage(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    wanted = min(float(TRAIN_ROWS), MOST_ROWS / max(1, counts.count()))
    shares = counts.select("lang", (F.lit(wanted) / F.col("n")).alias("share"))
    drawn = F.xxhash64("doc_id", "text")
    chance = F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30))
    begin = F.pmod(F.shiftright(drawn, 30), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int") + 1
    near = rows.select("lang", chance.alias("chance"), F.substring(F.col("text"), begin, F.lit(TRAIN_CHARS)).alias("text"))
    return near.join(small_side(shares, F.octet_length("lang") + 32), "lang").filter("chance < share").select("text", "lang")


def fit(docs: DataFrame) -> dict | None:
    """Model from the labelled rows of ``docs``; None if there are none."""
    sample = learnable(docs).orderBy("lang", "text").toArrow()  # bounded: MOST_ROWS passages of TRAIN_CHARS characters
    if not sample.num_rows:
        return None
    return train((text.as_py() for text in sample.column("text")), sample.column("lang").to_pylist())


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """Adds lang_pred, score and rejected to ``docs``; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = ("lang_pred", "score", "rejected")
    rows = docs.select(*[c for c in docs.columns if c not in own])
    at, names_out = rows.columns.index("text"), [*rows.columns, *own]
    schema = StructType([*rows.schema.fields, *(StructField(name, kind) for name, kind in zip(own, (StringType(), DoubleType(), BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                n = part.num_rows
                names, scores = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
                if m is not None:
                    sums, counts = pooled([text or "" for text in part.column(at).to_pylist()], m["folded"])
                    chance = softmax((sums / np.maximum(counts, 1)[:, None] + m["bias"]) / m["temperature"])
                    known = counts > 0
                    names[known] = np.array(m["names"], dtype=object)[chance.argmax(axis=1)[known]]
                    scores[known] = chance.max(axis=1)[known]
                rejected = (names == UNKNOWN) | (scores < (m["least"] if m else 0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(rejected)], names_out)

    return rows.mapInArrow(run, schema)
