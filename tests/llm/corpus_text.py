"""Random prose for fixtures."""

import random


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))
