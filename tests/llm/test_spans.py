"""Pieces and spans of sentences against plain loops."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import sentence_dedup as sd
from granary.llm.textkit import blocks


def plain_pieces(text):
    return [x for x in re.findall(r"[^.!?,;:\n]*[.!?,;:\n]*[ \t\n\x0b\f\r]*", text) if x]


def plain_spans(text, least):
    plain = [re.sub(r"[ \t\n\x0b\f\r]+", " ", p).strip(" ").lower() for p in plain_pieces(text)]
    out = []
    for i in range(len(plain)):
        n = 0
        for j in range(i, len(plain)):
            n += plain[j].count(" ") + 1
            if n >= least and j > i:
                out.append((" ".join(plain[i : j + 1]), i, j))
                break
    if not out or out[-1][2] < len(plain) - 1:
        lo = out[-1][1] if out else 0
        out.append((" ".join(plain[lo:]), lo, len(plain) - 1))
    return out


@pytest.mark.parametrize("least", [1, 2, 5, 20])
def test_spans_equal_plain(least):
    rnd = random.Random(least)
    texts = ["".join(rnd.choice("aB .,\n\t!é;\r\x0b") for _ in range(rnd.randint(1, 80))) for _ in range(400)]
    texts += ["".join(rnd.choice(["word ", "an", "Es ", ". ", ",", "\n", "\n\n ", "  ", "! ?"]) for _ in range(rnd.randint(1, 60))) for _ in range(400)] + ["a", ".", " .", "\n\n a", ". .", " a.\n.b \n.c", "x" * 5000]
    texts = [t for t in texts if re.search(r"[^ \t\n\x0b\f\r]", t)]
    of_hash, of_span, row = {}, {}, 0
    for first, data, starts in blocks(pa.array([t.lower().encode() for t in texts], pa.binary())):
        text, h, lo, hi = sd.spans_of(data, starts, least)
        begin, at = sd.piece_starts(data, starts), 0
        for k in range(len(starts) - 1):
            t = texts[first + k].lower().encode()
            mine = begin[(begin >= starts[k]) & (begin < starts[k + 1])] - starts[k]
            assert [t[a:b].decode() for a, b in zip(mine, [*mine[1:], len(t)], strict=True)] == plain_pieces(texts[first + k].lower()), texts[first + k]
            due = plain_spans(texts[first + k], least)
            got = sorted(zip(lo[text == k].tolist(), hi[text == k].tolist(), h[text == k].tolist(), strict=True))
            assert [(a, b) for a, b, _ in got] == sorted((a, b) for _, a, b in due), texts[first + k]
            for (a, b, x), (span, _, _) in zip(got, sorted(due, key=lambda r: r[1:]), strict=True):
                assert of_hash.setdefault(x, span) == span and of_span.setdefault(span, x) == x
            row += 1
    assert row == len(texts) and len(np.unique(list(of_hash))) == len(of_span)
