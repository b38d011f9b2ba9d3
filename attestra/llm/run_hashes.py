"""64-bit hashes of runs of symbols (the words of a block of texts), all runs at once in arrays."""

from __future__ import annotations

from functools import cache

#: Runs of more symbols than this are hashed one by one.
LONG = 64
_A, _B, _C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@cache
def _weights(seed: int):
    """Random odd numbers, one for each place of a run."""
    import numpy as np

    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, LONG, np.uint64) | np.uint64(1)


def run_hashes(symbols, starts, lens, seeds: tuple[int, ...] = (1,)) -> list:
    """A uint64 array for each seed: the hashes of symbols[start : start + len], equal for equal runs in any block. starts
    ascend, every len is 1 or more, and symbols outside the runs are 0."""
    import numpy as np

    if not len(starts):
        return [np.empty(0, np.uint64) for _ in seeds]
    v = symbols.astype(np.uint64)
    v *= np.uint64(_A)
    v ^= v >> np.uint64(32)
    v *= np.uint64(_B)
    place = np.arange(len(symbols), dtype=np.int32)
    place[starts[0] :] -= np.repeat(starts.astype(np.int32), np.diff(starts, append=len(symbols)))
    place &= LONG - 1
    out = []
    for seed in seeds:
        h = np.add.reduceat(v * _weights(seed).take(place), starts)
        h += lens.astype(np.uint64) * np.uint64(_C)
        h ^= h >> np.uint64(32)
        h *= np.uint64(_B)
        h ^= h >> np.uint64(29)
        out.append(h)
    many = np.flatnonzero(lens > LONG).tolist()
    if many:
        import xxhash

        for i in many:
            run = symbols[starts[i] : starts[i] + lens[i]].tobytes()
            for h, seed in zip(out, seeds):
                h[i] = xxhash.xxh3_64_intdigest(run, seed)
    return out


def distinct(hashes) -> tuple:
    """(first, which): where each distinct hash stands first, and for every hash the number of its distinct one."""
    import numpy as np
    import pyarrow as pa

    which = pa.array(hashes).dictionary_encode().indices.to_numpy()
    first = np.empty(int(which.max()) + 1 if len(which) else 0, np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return first, which
