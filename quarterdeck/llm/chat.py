r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text and encoded once, with offsets. The spans of the
turns that bear loss are sorted and disjoint; every token finds the spans it meets by
binary search, and the characters under the mask are the intersections of token spans
and turn spans. A token that crosses a boundary therefore never adds template text.

Template of a turn: ``### ROLE: TEXT </turn>\n``. Inside roles and texts the backslash is
doubled and a backslash is put before every ``###`` and ``</turn>`` and, in roles, before
every colon; deleting one backslash before any character restores them.

Defined results: rows are ordered by turn, nulls first, then role, then text; null roles
and texts count as empty; a null conv_id is a conversation; repeated rows are repeated
turns; an empty table gives no rows. Other columns are ignored. A conversation is
one value, as its text is encoded whole; a very long one takes memory in proportion to its length in its own task.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
LOSS_ROLES = ("assistant",)
FORMATTED = "conv_id long, formatted string, n_tokens long, token_ids array<int>, loss_mask array<boolean>, loss_starts array<int>, loss_ends array<int>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def render(turns: list[tuple[str, str]], loss_roles=LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the sorted spans of the (escaped) texts that bear loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}{SEP}", escape(text)
        at += len(head)
        if role in loss_roles:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        parts += [head, body, CLOSE]
    return "".join(parts), spans


_TURN = re.compile(r"(?s)### ((?:\\.|[^\\:])*): ((?:\\.|(?! </turn>\n)[^\\])*) </turn>\n")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def align(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[list[bool], list[tuple[int, int]]]:
    """Token mask and the intersections of tokens and spans as disjoint sorted pieces.

    Both lists are sorted. Tokens that share a character (parts of one code point) add it once.
    """
    starts, ends = [s for s, _ in spans], [e for _, e in spans]
    mask, pieces, done = [], [], 0
    for a, b in offsets:
        first, last = bisect_right(ends, a), bisect_left(starts, b)
        hit = [(max(a, starts[i]), min(b, ends[i])) for i in range(first, last)]
        hit = [(s, e) for s, e in hit if e > s]
        mask.append(bool(hit))
        for s, e in hit:
            s = max(s, done)
            if e > s:
                done = e
                if pieces and pieces[-1][1] == s and bisect_left(starts, s) == bisect_left(starts, pieces[-1][0] + 1):
                    pieces[-1] = (pieces[-1][0], e)
                else:
                    pieces.append((s, e))
    return mask, pieces


def format_chats(rows: DataFrame, tokenizer: str, loss_roles=LOSS_ROLES) -> DataFrame:
    """One row per conversation: formatted text, token ids, token mask and the masked character pieces."""
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer
        encoder = Tokenizer.from_file(tokenizer)
        encoder.encode_special_tokens = True
        encoder.no_truncation()
        encoder.no_padding()
        for batch in batches:
            out = []
            for conv_id, turns in zip(batch["conv_id"], batch["turns"]):
                text, spans = render([(t["role"], t["text"]) for t in turns], loss_roles)
                coded = encoder.encode(text, add_special_tokens=False)
                mask, pieces = align(coded.offsets, spans)
                out.append((None if pd.isna(conv_id) else int(conv_id), text, len(coded.ids), coded.ids, mask, [s for s, _ in pieces], [e for _, e in pieces]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FORMATTED.split(", ")]).astype({"conv_id": "Int64"})

    return turns.mapInPandas(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted texts and masks."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                turns = parse(row.formatted)
                loss = unescape("".join(row.formatted[s:e] for s, e in zip(row.loss_starts, row.loss_ends)))
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((None if pd.isna(row.conv_id) else int(row.conv_id), len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(row.formatted), row.n_tokens))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")]).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends", "n_tokens").mapInPandas(run, kinds)
