"""Token counts of whole texts by overlap resynchronisation.

Texts of up to ``CHUNK`` characters are encoded whole, by the library. A longer text is
encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a
token boundary that both have inside their overlap and that is proven stable: no piece of
the vocabulary holds the two characters beside it next to each other, so no merge can
cross it and both sides are encoded as in the whole text. If the overlap has no such
boundary it is widened, in the end to the rest of the text, so the count is always exact.

The work is a map over rows: nothing is shuffled or collected, and memory follows a batch
of texts and one chunk. Lost tasks are run again.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give
repeated rows; an empty table gives no rows. Only doc_id is carried over.

The proof needs a model that normalises nothing but spaces; the counter refuses others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: characters encoded at once, and the overlap of neighbouring chunks to begin with
CHUNK, OVERLAP = 8192, 512
#: characters handed to the library in one call
CALL_CHARS = 1 << 19
LIMIT = 4096
SPACE = "\u2581"


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        probe = "  \ufb01\u00bd  \u3000 "  # any folding, or removal of white space, would show
        if "".join(piece for piece in model.encode(probe, out_type=str)) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model normalises texts; stable boundaries can't be proven")
        self.joined = {piece[i:i + 2] for piece in map(model.id_to_piece, self._plain()) for i in range(len(piece) - 1)}

    def _plain(self) -> list[int]:
        m = self.model
        return [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1:at + 1].replace(" ", SPACE) not in self.joined

    def starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where the tokens of text[begin:end] start, as positions in the text."""
        return [begin + first for first, _ in self.model.encode(text[begin:end], return_type="offset_mapping")["offsets"]]

    def splice(self, text: str, left: list[int], begin: int, end: int, floor: int) -> tuple[int, int, list[int]] | None:
        """A stable boundary that the left chunk (ending at ``end``) shares with the chunk from ``begin``, and that chunk."""
        stop = min(len(text), begin + self.chunk)
        right = self.starts(text, begin, stop)
        shared = set(left)
        for at in right:
            if max(begin, floor) < at < end and at in shared and self.stable(text, at):
                return at, stop, right
        return None

    def count_long(self, text: str) -> int:
        total, at, end = 0, 0, min(self.chunk, len(text))
        tokens = self.starts(text, 0, end)
        while end < len(text):
            overlap, found = min(self.overlap, self.chunk // 2), None
            while found is None and overlap < self.chunk and end - overlap > at:
                found = self.splice(text, tokens, end - overlap, end, at)
                overlap *= 2
            if found is None:  # no boundary in any overlap: a longer chunk from the last splice
                begin = max(0, at - 1)
                end = min(len(text), begin + 2 * (end - begin))
                tokens = self.starts(text, begin, end)
                continue
            place, stop, right = found
            total += sum(at <= t < place for t in tokens)
            at, end, tokens = place, stop, right
        return total + sum(t >= at for t in tokens)

    def __call__(self, texts: list[str]) -> list[int]:
        out, held, chars = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = self.count_long(text)
            else:
                held.append(i)
                chars += len(text)
            if held and (chars >= CALL_CHARS or i == len(texts) - 1):
                for j, ids in zip(held, self.model.encode([texts[j] for j in held], num_threads=1)):
                    out[j] = len(ids)
                held, chars = [], 0
        if held:
            for j, ids in zip(held, self.model.encode([texts[j] for j in held], num_threads=1)):
                out[j] = len(ids)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tokens = count([text or "" for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
