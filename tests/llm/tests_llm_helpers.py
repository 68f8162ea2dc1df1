"""Invented prose and brute-force versions that several tests share."""

import random
import re

import xxhash

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(("", "s", "y", "en")) for _ in range(n))


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    parent = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    low = min(parent[i], parent[j])
                    parent[i] = parent[j] = low
    return {(i, f): ids[p] for i, f, p in zip(ids, fps, parent, strict=True)}


def shingles(text, k=5):
    words = re.findall("[^\x20\x09-\x0d]+", text.lower())
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_near_groups(texts):
    """Text to the first text it reaches: 3 bits, or 11 bits and a 5-word similarity of 0.8."""
    fps, sets = [brute_fingerprint(t) for t in texts], [shingles(t) for t in texts]
    parent = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                bits = (fps[i] ^ fps[j]).bit_count()
                if bits <= 3 or (bits <= 11 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    return parent
