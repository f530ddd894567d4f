"""Made-up texts for the tests."""

from __future__ import annotations

import random


def words(n: int, seed: int, stem: str = "w") -> str:
    r = random.Random(seed)
    return " ".join(f"{stem}{r.randrange(10**6)}" for _ in range(n))


def edited(text: str, every: int, seed: int) -> str:
    w = text.split()
    r = random.Random(seed)
    for i in range(r.randrange(every), len(w), every):
        w[i] = f"x{r.randrange(10**6)}"
    return " ".join(w)
