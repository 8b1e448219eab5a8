"""Texts for the tests."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


#: Texts that every operator must bear: nothing, white space, one character, repeats, other scripts, a very long one.
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "same text here"), (5, "same text here"), (6, "same text here"), (None, "no id at all"), (7, "é 你好   \U0001f600 end"), (8, "word " * 60_000)]
