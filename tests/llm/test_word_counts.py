"""Words counted within tasks, and the size of their tries."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from spreadrank.llm import sentencepiece_lattice as lattice


@pytest.mark.parametrize("limit", [1 << 20, 50, 3])
def test_words_are_summed_up_over_runs(monkeypatch, limit):
    """A task returns a word once, not once for each run of text, unless there are too many to hold."""
    monkeypatch.setattr(lattice, "COUNTED", 40)
    r = random.Random(4)
    texts = [r.choice([None, "", "   ", " a b", " é\U0001f600 a\n\nb", " " + "x" * 70]) if r.random() < 0.7 else f" {r.randrange(60)} a" for _ in range(400)]
    want = collections.Counter(w for t in texts for w in re.findall(lattice.WORDS, t or ""))
    batches = [pa.record_batch([pa.array(texts[i : i + 100], pa.string())], names=["text"]) for i in range(0, 400, 100)]
    out = pa.Table.from_batches(list(lattice._counted(iter(batches), limit))).to_pylist()
    got = collections.Counter()
    for x in out:
        got[x["word"]] += x["n"]
    assert got == want
    assert len(out) == len(want) or limit < len(want)


def test_tries_are_small():
    """The fold copies its state for each node of a trie: its work grows with the square of the nodes."""
    words = sorted(np.random.default_rng(1).integers(10**9, 10**10, 1000).astype(str))
    model = lattice.Model([(str(k), -1.0, k) for k in range(10)], None, 0)
    rows = list(lattice.Pieces(model).lattice(iter([pa.record_batch([pa.array(words), pa.array(np.ones(1000, np.int64))], names=["word", "n"])])))
    assert [w for b in rows for x in b.column(0).to_pylist() for w in x] == words
    assert max(len(x) for b in rows for x in b.column(3).to_pylist()) <= 160
