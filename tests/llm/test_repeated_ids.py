"""One id with several texts in the near-copy join."""

import random

from quarterdeck.llm import chosen_path
from test_documents import brute_classes, sentence


def test_jaccard_join_of_one_id_with_two_texts(docs):
    rnd, rows = random.Random(12), []
    for g in range(6):
        base = sentence(rnd, 100).split()
        for k in range(3):
            copy = list(base)
            copy[20 * k] = f"new{k}"
            rows.append((g // 2 * 10 if k == 0 else 100 + 10 * g + k, " ".join(copy)))
    got = sorted(tuple(r) for r in chosen_path.jaccard_join(docs(rows)).collect())
    assert got == brute_classes(rows)
