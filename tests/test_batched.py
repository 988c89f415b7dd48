"""Alignments of many pairs at once against those of one pair at a time."""

import numpy as np

from tessera.operators import alignment, batched, stitching


def pairs():
    rng = np.random.default_rng(8)
    out = [("", ""), ("A", ""), ("", "CG"), ("ACGT", "ACGT"), ("A" * 1200, "C" * 1100)]
    for k in range(300):
        text = list(rng.choice(list("ACGT"), int(rng.integers(0, 90))))
        other = list(text) if k % 5 else list(rng.choice(list("ACGT"), int(rng.integers(0, 60))))
        for _ in range(int(rng.integers(0, 8))):
            at = int(rng.integers(0, len(other) + 1))
            other[at : at + int(rng.integers(0, 3))] = list(rng.choice(list("ACGT"), int(rng.integers(0, 3))))
        out.append(("".join(text), "".join(other)))
    return [list(x) for x in zip(*out)]


def test_many_at_once_are_those_of_one_at_a_time(monkeypatch):
    refs, queries = pairs()
    one = [stitching.segment_alignment(a, b) for a, b in zip(refs, queries)]
    assert stitching.segment_alignments(refs, queries) == one
    whole = [alignment.global_alignment(a, b) for a, b in zip(refs[5:], queries[5:])]
    for cells in (1, 1 << 14, 1 << 21):
        monkeypatch.setattr(batched, "CELLS", cells)
        assert batched.global_alignments(refs[5:], queries[5:]) == whole
        assert stitching.segment_alignments(refs[5:], queries[5:]) == one[5:]


def test_short_pairs_are_not_aligned_on_their_own(monkeypatch):
    monkeypatch.setattr(stitching, "global_alignment", None)
    monkeypatch.setattr(stitching, "near_alignment", None)
    refs, queries = pairs()
    assert len(stitching.segment_alignments(refs[:4] + refs[5:], queries[:4] + queries[5:])) == len(refs) - 1
