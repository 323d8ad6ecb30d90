"""What the tests of this folder share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def near_copies(n, length=300, most_edits=16, seed=2):
    """Texts that differ from one another in some of their words."""
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(500)}" for _ in range(length)]
    found = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(0, most_edits)):
            words[rnd.randrange(length)] = f"q{rnd.randrange(10**6)}"
        found.append(" ".join(words))
    return found


def passages(n, vocabulary, seed=5):
    """Texts that share, edit and overlap passages."""
    rnd = random.Random(seed)
    shared = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 90))] for _ in range(6)]
    found = []
    for _ in range(n):
        words = []
        for _ in range(rnd.randrange(0, 5)):
            words += [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 40))]
            own = list(rnd.choice(shared))
            own = own[rnd.randrange(0, 10) : len(own) - rnd.randrange(0, 10)]
            if rnd.random() < 0.3 and own:
                own[rnd.randrange(len(own))] = f"edit{rnd.randrange(5)}"
            words += own
        found.append(rnd.choice([" ", "\n", "  ", "\t"]).join(words))
    return found
