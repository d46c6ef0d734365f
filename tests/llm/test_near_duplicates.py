"""The chance of giving up a pair of exactly the threshold, over all batches of hashes."""

from math import comb

import numpy as np
import pytest

from tabloom.llm.near_duplicates import BATCH, HASHES, least_matches, signature, signature_constants


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_of_the_threshold_are_not_given_up(percent):
    least, p = least_matches(percent), percent / 100
    assert sorted(least) == list(range(BATCH, HASHES + 1, BATCH))
    going, lost = {0: 1.0}, 0.0
    for n in sorted(least):
        after = {}
        for m, chance in going.items():
            for k in range(BATCH + 1):
                after[m + k] = after.get(m + k, 0.0) + chance * comb(BATCH, k) * p**k * (1 - p) ** (BATCH - k)
        lost += sum(c for m, c in after.items() if m < least[n])
        going = {m: c for m, c in after.items() if m >= least[n]}
    assert lost <= 1e-6
    # Pairs far below the threshold are still given up early.
    assert least[BATCH] > BATCH * 0.3 and np.all(np.diff([least[n] for n in sorted(least)]) > 0)


def test_signatures_take_two_bytes_a_hash_and_keep_what_is_equal():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 9_000, dtype=np.uint64)
    b = np.concatenate([a[:8_000], rng.integers(0, 1 << 63, 1_000, dtype=np.uint64)])
    factors, masks = signature_constants()
    x, y = (signature(s, factors, masks) for s in (a, b))
    assert len(x.tobytes()) == 2 * HASHES
    whole = [
        (((s >> np.uint64(32)).astype(np.uint32)[:, None] ^ masks[None, :]) * factors[None, :]).min(axis=0) for s in (a, b)
    ]
    equal = whole[0] == whole[1]
    assert 0.7 < equal.mean() < 0.9
    assert (x == y)[equal].all() and (x == y).sum() <= equal.sum() + 1
