"""Toxic words beyond the 64th character of a run or token."""

import numpy as np

from quarterdeck.llm import toxicity


def restorer():
    """A language model of a few words."""
    text, n = " the house idiot was near that river " * 50, {}
    codes = [toxicity._CODE.get(c, 0) for c in text]
    codes = [c for i, c in enumerate(codes) if i == 0 or c or codes[i - 1]]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        cell = (a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c
        n[cell] = n.get(cell, 0) + 1
    return toxicity.language_model(list(n.items()))


def test_toxic_word_across_the_64th_character():
    words = toxicity.Words(restorer())
    for before in range(24, 38):
        lead = ("", "near", "house")[before % 3] + "the" * ((before - (0, 4, 5)[before % 3]) // 3)
        assert "idiot$" in words.of(" ".join(lead + "idiot" + "house")), before
    for before in range(56, 66):
        lead = "near/" * (before % 4) + "the/" * ((before - 5 * (before % 4)) // 4)
        assert "idiot$" in words.of(lead + "1d1ot/house"), before


def test_a_very_long_token_is_decoded_whole():
    words = toxicity.Words(restorer())
    told = words.restored("r1ver/" * 40_000 + "1d1ot")
    assert told[-1] == "idiot" and told.count("river") == 40_000
    assert not words.kept and np.isfinite(words.restorer.logs[0][0][0])
