"""Brute-force helpers of the corpus tests."""

from __future__ import annotations

import re

#: names that the operators use inside; a table may have them as its own columns
CLASH = ["row_id", "run", "size", "label", "node", "dropped_row", "mix_row", "mix_times", "numbered"]

ASCII = {65 + i: 97 + i for i in range(26)}


def shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if not found:
        return set()
    width = min(size, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def brute_components(sets: dict, percent: int) -> dict:
    ids = sorted(sets)
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for at, one in enumerate(ids):
        for other in ids[at + 1 :]:
            both = len(sets[one] & sets[other])
            if both and 100 * both >= percent * (len(sets[one]) + len(sets[other]) - both):
                low, high = sorted((root(one), root(other)))
                label[high] = low
    return {i: root(i) for i in ids}


def clashing(frame):
    """The frame with further columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit(name).alias(name) for name in CLASH])
