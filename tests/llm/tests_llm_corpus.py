import numpy as np


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("aeioustnrdé"), rng.integers(2, 8))) for _ in range(n))
