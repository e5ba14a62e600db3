import numpy as np
import pytest

from lodestone.llm import windows
from lodestone.llm.windows import PART, runs, sliding_minimum, stretches


def test_sliding_minimum():
    rng = np.random.default_rng(1)
    for n, width in ((5, 5), (100, 7), (64, 8), (33, 1)):
        x = rng.integers(0, 1 << 60, n).astype(np.uint64)
        assert sliding_minimum(x, width).tolist() == [x[i : i + width].min() for i in range(n - width + 1)]


@pytest.mark.parametrize("part", [64, PART])
def test_equal_windows_have_equal_anchors(monkeypatch, part):
    monkeypatch.setattr(windows, "PART", part)
    rng = np.random.default_rng(2)
    length, gram = 20, 6
    base = rng.integers(0, 4, 200).astype(np.uint64)
    sequences = [base, np.concatenate([rng.integers(0, 4, 37).astype(np.uint64), base[40:130]]), base[:10], np.zeros(60, np.uint64)]
    lengths = np.array([len(s) for s in sequences])
    place: dict[tuple, set] = {}
    seen = [0] * len(sequences)
    for which, start, count, offset, anchor, _ in runs(lambda i, s, e: (sequences[i][s:e], sequences[i][s:e]), lengths, gram, length):
        for w, s, c, o, a in zip(which, start, count, offset, anchor, strict=True):
            for k in range(c):
                window = tuple(sequences[w][s + k : s + k + length].tolist())
                assert len(window) == length
                place.setdefault(window, set()).add((a, o - k))
                seen[w] += 1
    assert seen == [max(0, n - length + 1) for n in lengths]
    assert all(len(p) == 1 for p in place.values())


def test_stretches():
    assert [x.tolist() for x in stretches(np.array([1, 1, 0, 1, 0, 0, 1], bool))] == [[0, 3, 6], [2, 4, 7]]
    assert [x.tolist() for x in stretches(np.zeros(0, bool))] == [[], []]
