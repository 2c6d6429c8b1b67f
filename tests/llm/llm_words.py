"""Word lists for the tests of this folder."""

import random


def chain(groups: int = 2, members: int = 30):
    """(id, text): in each group neighbours are near copies, the ends are not;
    one group of near copies of one base; unrelated texts that share a line."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(5))
    rows, n = [], 0
    for _ in range(groups):
        text = [word() for _ in range(120)]
        for _ in range(members):
            rows.append((n, " ".join(text)))
            n += 1
            at = r.randrange(0, 118)
            text = text[:at] + [word(), word()] + text[at + 2:]
    base = [word() for _ in range(100)]
    for _ in range(40):
        own = list(base)
        own[r.randrange(100)] = word()
        own[r.randrange(100)] = word()
        rows.append((n, " ".join(own)))
        n += 1
    line = [word() for _ in range(12)]
    for _ in range(30):
        rows.append((n, " ".join([word() for _ in range(20)] + line + [word() for _ in range(20)])))
        n += 1
    r.shuffle(rows)
    return rows
