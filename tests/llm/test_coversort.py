"""Blockwise suffix sorting against a count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from siftwell.llm.coversort import COVERS, repeated_windows


@pytest.mark.parametrize("period", sorted(COVERS))
def test_covers_hold_every_difference(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


@pytest.mark.parametrize("length", [1, 2, 8, 9, 12, 21, 30, 45, 64, 100, 400])
def test_repeated_windows(length):
    rnd = random.Random(length)
    for alphabet in (b"a", b"ab", b"abcd\0\xff"):
        word = lambda n: bytes(rnd.choice(alphabet) for _ in range(n))  # noqa: B023, E731
        strings = [word(600)]
        for _ in range(12):
            base = rnd.choice(strings)
            a = rnd.randint(0, len(base))
            strings.append(word(rnd.randint(1, 40)) + base[a : rnd.randint(a, len(base))] + word(rnd.randint(0, 40)))
        counts = Counter(s[k : k + length] for s in strings for k in range(len(s) - length + 1))
        want = [k + length <= len(s) and counts[s[k : k + length]] > 1 for s in strings for k in range(len(s))]
        ends = np.cumsum([len(s) for s in strings])
        begins = np.concatenate([[0], ends[:-1]])
        for bucket in (1, 50, 1 << 17):
            assert repeated_windows(np.frombuffer(b"".join(strings), np.uint8), begins, ends, length, bucket).tolist() == want
