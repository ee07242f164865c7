"""The k best windows of a line are those that comparing every window gives, at fewer comparisons."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np

from cuesheet.functions import text as tx
from cuesheet.operators.alignment import WindowTexts


def plain(line, texts, centres, expected, penalty, k, least):
    out = []
    for x, centre in zip(texts, centres, strict=True):
        held = 0.45 * len(line) / len(x) + 0.08 if line in x else 0.40 * len(x) / len(line) + 0.08 if x in line else 0.0
        ratio = min(1.0, max(SequenceMatcher(None, x, line).ratio(), held))
        near = 0.5 if expected is None else max(0.0, 1 - abs(centre - expected) / 12.0)
        if ratio >= least:
            out.append((-round(0.82 * ratio + 0.18 * near - penalty, 9), centre, ratio))
    return [(c, r, -s) for s, c, r in sorted(out)[:k]]


def test_bounds_lose_no_window(monkeypatch):
    rng, calls, lifted = random.Random(5), [0], tx.lifted_ratio

    def counted(*args):
        calls[0] += 1
        return lifted(*args)

    monkeypatch.setattr(tx, "lifted_ratio", counted)
    compared = 0
    for nr in range(12):
        words = ["".join(rng.choice("aeinrstlo" if nr % 2 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(80)]
        texts = ["".join(words[i // 2 : i // 2 + 9]) for i in range(2 * len(words))]
        centres = np.arange(len(texts)) * 0.25
        known = WindowTexts(texts, centres)
        for line in ("".join(words[20:29]), "".join(words[5:7]), "a", texts[3] + texts[60] + "zz", "QQQ", "".join(rng.sample(words, 9))):
            for expected in (None, 7.0, 500.0):
                assert known.best(line, expected, 0.03, 12.0, 8, 0.06, None) == plain(line, texts, centres.tolist(), expected, 0.03, 8, 0.06)
                compared += len(texts)
    assert calls[0] < compared / 2
