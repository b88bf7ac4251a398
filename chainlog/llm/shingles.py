"""Hashes of word shingles and consistent weighted samples of them, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:  # doubles what is there
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


POWERS = _powers(BASE, 2 * CHUNK + 2)
INVERSES = _powers(pow(BASE, -1, 1 << 64), 2 * CHUNK + 2)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
PLACES = _powers(0xD6E8FEB86659FD93, SHINGLE + 1)[1:]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: bytes) -> np.ndarray:
    """Hashes of the words of at most 2 * CHUNK bytes, in order."""
    chars = np.frombuffer(data, np.uint8)
    solid = ~IS_SPACE[chars]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * POWERS[: len(chars)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * INVERSES[starts] + np.uint64(1))


def _parts(data: bytes):
    """A long text in parts that end at a space, as far as it has any."""
    at = 0
    while len(data) - at > CHUNK:
        cut = max(data.rfind(b" ", at, at + CHUNK), data.rfind(b"\n", at, at + CHUNK))
        cut = at + CHUNK if cut <= at else cut
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, lower-cased, and each text's number of words."""
    hashes, counts, group, size = [], [], [], 0

    def flush() -> None:
        nonlocal size
        if group:
            data = b"\n".join(group)
            found = _hash_words(data)
            chars = np.frombuffer(data, np.uint8)
            solid = ~IS_SPACE[chars]
            begins = np.flatnonzero(np.diff(solid, prepend=False) & solid)
            ends = np.cumsum([len(g) + 1 for g in group])
            at = np.searchsorted(begins, ends)
            counts.extend(np.diff(at, prepend=0).tolist())
            hashes.append(found)
            group.clear()
            size = 0

    for text in texts:
        data = text.lower().encode()
        if len(data) > CHUNK:
            flush()
            own = [_hash_words(p) for p in _parts(data)]
            hashes += own
            counts.append(sum(map(len, own)))
            continue
        if size + len(data) + 1 > CHUNK:
            flush()
        group.append(data)
        size += len(data) + 1
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(counts, np.int64)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, times, sizes): each text's distinct shingles in ascending order, how often it has them, and how many.

    A text of one to four words has one shingle, all of it; a text without words has none.
    """
    words, counts = word_hashes(texts)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    padded = np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)])
    n = len(words)
    text_of = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the text's end
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += np.where(left > i, padded[i : n + i], np.uint64(0)) * PLACES[i]
    first = np.arange(n) == np.repeat(np.cumsum(counts) - counts, counts)
    keep = (left >= SHINGLE) | first
    found = mixed(total + np.minimum(left, SHINGLE).astype(np.uint64))[keep]
    per_text = np.bincount(text_of[keep], minlength=len(counts))
    ends = np.cumsum(per_text)
    for a, b in zip((ends - per_text).tolist(), ends.tolist()):
        found[a:b].sort()
    owner = np.repeat(np.arange(len(counts)), per_text)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(found)))
    return found[at], times, np.bincount(owner[at], minlength=len(counts))


class Sampler:
    """Improved consistent weighted sampling: for each of k functions, a shingle and a level of its weight, so that two texts
    draw the same with the probability of their weighted Jaccard similarity.

    A function draws r and c from Gamma(2, 1) and b from U(0, 1) for each shingle, here from tables of 65,536 values by two
    16-bit hashes of shingle and function; the level is t = floor(ln w / r + b), and the least ln c - r (t - b + 1) wins.
    plain is the weight that most shingles have.
    """

    def __init__(self, k: int, plain: float = 1.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, 65536).astype(np.float32)
        self.b = rng.random(65536).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, 65536)).astype(np.float32)
        self.factors = rng.integers(0, MASK, k, dtype=np.uint64, endpoint=True) | np.uint64(1)
        self.plain = plain
        self.plain_score = self._score(np.arange(65536), np.float32(np.log(plain)))

    def _score(self, at: np.ndarray, log_w) -> np.ndarray:
        return self.r[at] * (np.floor(log_w / self.r[at] + self.b[at]) - self.b[at] + np.float32(1))

    def samples(self, shingles: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of k hashes for each text; every text must have a shingle."""
        starts = np.cumsum(sizes) - sizes
        log_w = np.log(weights).astype(np.float32)
        odd = np.flatnonzero(weights != self.plain)
        out = np.empty((len(sizes), len(self.factors)), np.uint64)
        for k, factor in enumerate(self.factors):
            x = shingles * factor
            x ^= x >> np.uint64(32)
            x *= factor
            first, second = (x >> np.uint64(48)).view(np.int64), ((x >> np.uint64(32)) & np.uint64(0xFFFF)).view(np.int64)
            score = self.log_c[second] - self.plain_score[first]
            if len(odd):
                score[odd] = self.log_c[second[odd]] - self._score(first[odd], log_w[odd])
            least = np.minimum.reduceat(score, starts)
            hits = np.flatnonzero(score == np.repeat(least, sizes))
            won = hits[np.searchsorted(hits, starts)]  # shingles ascend within a text, so ties go to the least
            at = first[won]
            level = np.floor(log_w[won] / self.r[at] + self.b[at]).astype(np.int64).view(np.uint64)
            out[:, k] = mixed(shingles[won] + mixed(level + np.uint64(k << 32)))
        return out


def jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two ascending sets."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = b[at] == a
    both = np.minimum(wa[hit], wb[at[hit]]).sum()
    return float(both / (wa.sum() + wb.sum() - both))
