"""Least values of blocks of shingles, a row for each block."""

import numpy as np

from tidemark.llm import license_scan


def test_block_minima_are_those_of_the_blocks():
    s = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 63, size=license_scan.PART + 1003, dtype=np.uint64)
    for own in (s, s[:1], s[:37]):
        for size in (1, 2, 8, 64):
            got = license_scan.block_minima(own, size)
            want = [license_scan.least_values(own[k : k + size]) for k in range(0, len(own), size)]
            assert got.shape == (len(want), license_scan.BANDS) and (got == np.array(want)).all()
