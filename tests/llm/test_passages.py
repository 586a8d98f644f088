"""Repeated passages of one to five lines against brute force."""

import random

from quarterdeck.llm import line_chunks


def brute_lost(rows, words=line_chunks.RUN_WORDS):
    """Line numbers, by id, of the runs of more than ``words`` words whose windows, or only line, came before."""
    seen, lost = set(), {}
    for doc_id, text in sorted(((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = text.split("\n")
        size = [len(line.split()) for line in lines]
        gone, first = set(), None
        old = [(a, b) in seen or seen.add((a, b)) is not None for a, b in zip(lines, lines[1:])] + [False]
        for i, again in enumerate(old):
            if again and first is None:
                first = i
            if not again and first is not None:
                if sum(size[first:i + 1]) > words:
                    gone |= set(range(first, i + 1))
                first = None
            if size[i] > words:
                if lines[i] in seen:
                    gone.add(i)
                seen.add(lines[i])
        lost[doc_id] = gone
    return lost


def test_passages_of_one_to_five_lines_go(docs):
    rnd = random.Random(9)
    line = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    rows, n, passages = [], 0, []
    for length in range(1, 6):
        for _ in range(6):
            passage = [line(60 // length + 1) for _ in range(length)]
            for copy in range(3):
                rows.append((n, "\n".join([line(8) for _ in range(rnd.randint(0, 3))] + passage + [line(8) for _ in range(rnd.randint(1, 3))])))
                if copy:
                    passages.append((n, passage))
                n += 1
    short = line(10)
    rows += [(n, f"{short}\n{short} b\nown {n}"), (n + 1, f"{short}\n{short} b\nown {n + 1}"), (n + 2, None), (n + 3, ""), rows[1], rows[1]]
    out = {r["doc_id"]: r for r in line_chunks.dedup_passages(docs(rows)).collect()}
    for doc_id, passage in passages:
        assert not set(passage) & set(out[doc_id]["text"].split("\n"))
    texts, lost = dict(rows), brute_lost(dict(rows).items())
    alone = {r["doc_id"]: r for r in line_chunks.dedup_lines(docs(rows)).collect()}
    for doc_id, text in texts.items():
        if text is not None:
            want = [x for i, x in enumerate(text.split("\n")) if i not in lost[doc_id]]
            left = out[doc_id]["text"].split("\n") if out[doc_id]["text"] else []
            assert set(left) <= set(want)  # chunks may take more, but only what they take alone
            assert set(want) - set(left) - {""} <= set(text.split("\n")) - set(alone[doc_id]["text"].split("\n"))
            assert out[doc_id]["lines_removed"] == out[doc_id]["n_lines"] - len(left) or not left
    everything = {x for text in texts.values() for x in (text or "").split("\n")}
    assert everything - {x for r in out.values() for x in (r["text"] or "").split("\n")} <= {""}
    assert out[n + 2]["text"] is None and out[n + 3]["text"] == "" and out[0]["size"] == 1
    assert line_chunks.dedup_passages(docs([])).count() == 0
