"""What decides between texts by their word shingles: shingle sets, MinHash band keys, and the comparison of whole sets in blocks."""

from __future__ import annotations

WORDS, SIMILARITY = 5, 0.8
BANDS, PER_BAND = 24, 5
#: Nodes of a block; a task compares two blocks.
BLOCK = 256
#: Shingles that a comparison looks at together, about.
RANGE = 1 << 17


def shingles(text: str | None, words: int = WORDS):
    """The set of a text's word shingles as sorted XXH64 values (A-Z lowered; a shorter text is one shingle, a wordless one has none)."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, "u8")
    f, n = xxhash.xxh64_intdigest, max(1, len(w) - words + 1)
    whole = memoryview(b" ".join(w))
    ends, at = [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.fromiter((f(whole[starts[i] : ends[min(i + words, len(w)) - 1]], 42) for i in range(n)), "u8", n))


def band_keys(s, flip, times):
    """The keys of a set's bands: hashes of the minima of PER_BAND seeded rehashes each."""
    import numpy as np
    import xxhash

    if not len(s):
        return []
    least = np.full(len(flip), np.iinfo("u8").max, "u8")
    for lo in range(0, len(s), 1024):
        np.minimum(least, ((s[lo : lo + 1024, None] ^ flip) * times).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, PER_BAND))]


def near(sets: list, similarity: float = SIMILARITY):
    """bool [n, n]: which of the sorted sets have at least that Jaccard similarity."""
    import numpy as np

    size = np.array([len(s) for s in sets], "f8")
    common = np.zeros((len(sets), len(sets)))
    # by ranges of the hashes, so that long texts take no more memory at once than short ones
    ranges = int(size.sum()) // RANGE + 1
    edges = [(k << 64) // ranges for k in range(1, ranges)]
    cuts = [[0, *np.searchsorted(s, np.array(edges, "u8")).tolist(), len(s)] for s in sets]
    for k in range(ranges):
        parts = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in parts])
        _, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = n > 1
        column = np.cumsum(shared) - 1
        take = shared[place]
        owner, column = owner[take], column[place[take]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for lo in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            m = np.zeros((len(sets), min(4096, int(shared.sum()) - lo)), "f4")
            m[owner[a:b], column[a:b] - lo] = 1
            common += m @ m.T
    np.fill_diagonal(common, size)
    return common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
