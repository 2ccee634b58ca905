"""Literal re-statements of the rules under test."""

import random
import re

SPACE = r"[^\x20\x09-\x0D]+"
STEMS = "ba do mi ta ren sol kip vor lun dra fe gu pan tor wex zil hum nor".split()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(SPACE, text or "")


def shingle_list(text, width=5):
    w = words(lower(text or ""))
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or ([tuple(w)] if w else [])


def prose(rng: random.Random, n):
    return " ".join("".join(rng.choice(STEMS) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng: random.Random, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def corpus(seed, n=40):
    """Texts with exact copies, near copies, chains of near copies, shared passages and short ones."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    out = []
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0 and out:
            out.append(rng.choice(out))
        elif kind == 1 and out:
            t = rng.choice(out)
            out.append(edited(rng, t, rng.randint(1, 4)) if t.strip() else t)
        elif kind == 2:
            out.append(f"{prose(rng, rng.randint(5, 80))} {passage} {prose(rng, rng.randint(5, 80))}")
        elif kind == 3:
            out.append(prose(rng, rng.randint(0, 8)))
        else:
            out.append(prose(rng, rng.randint(20, 150)))
    return out
