"""Counting and looking up n-grams in numpy, against Python."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from spreadrank.llm import kneser_ney


@pytest.mark.parametrize("limit", [1 << 20, 100, 3])
def test_counts_are_summed_up_over_runs(monkeypatch, limit):
    """A task returns an n-gram once, not once for each run of text, unless there are too many to hold."""
    monkeypatch.setattr(kneser_ney, "RUN", 64)
    r = random.Random(5)
    rows = [(r.choice(["ab", "a b c", "é\U0001f600", "", None, "b" * 90]), r.choice(["en", "de"]), r.random() < 0.5) for _ in range(300)]
    batches = [pa.record_batch([pa.array(x) for x in zip(*rows[i : i + 100], strict=True)], names=["text", "lang", "trains"]) for i in (0, 100, 200)]
    n, c = collections.Counter(), collections.Counter()
    for text, lang, trains in rows:
        stream = "\2\2" + "".join(w + " " for w in (text or "").split()) if text else ""
        for i in range(2, len(stream)):
            n[lang, stream[i - 2 : i + 1]] += 1
            c[lang, stream[i - 2 : i + 1]] += trains
    out = pa.Table.from_batches(list(kneser_ney.counted(3, limit)(iter(batches)))).to_pylist()
    got = [collections.Counter(), collections.Counter()]
    for x in out:
        got[0][x["lang"], x["gram"]] += x["n"]
        got[1][x["lang"], x["gram"]] += x["c"]
    assert got[0] == n and +got[1] == +c
    assert len(out) == len(n) or limit < len(n)


def test_hashes_with_the_same_first_bits():
    """Hashes are grouped and found by all of their bits."""
    r = np.random.default_rng(6)
    keys = np.concatenate((r.integers(0, 8, 300).astype(np.uint64), r.integers(0, 1 << 62, 300).astype(np.uint64), np.array([0, (1 << 64) - 2, (1 << 64) - 1], np.uint64)))
    order, heads = kneser_ney.grouped(keys)
    assert sorted(order) == list(range(len(keys)))
    assert all(len(set(keys[part])) == 1 for part in np.split(order, heads[1:]))
    known = np.unique(keys)[::2]
    scores = kneser_ney.Scores(known[::-1].copy(), -known[::-1].astype(float))
    want = [-float(k) if k in set(known.tolist()) else None for k in keys.tolist()]
    assert [None if np.isnan(x) else x for x in scores.find(keys).tolist()] == want
    assert np.isnan(kneser_ney.Scores(known[:0], np.zeros(0)).find(keys)).all()
