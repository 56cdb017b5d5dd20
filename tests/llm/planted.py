"""Texts with planted personal data that the strict patterns do not give, and decoys."""

import random

WORDS = "the of and reading house river small green window paper street morning letter table music garden winter number city people".split()


def card(rnd):
    d = [4] + [rnd.randrange(10) for _ in range(14)]
    total = sum(x if k % 2 else (2 * x - 9 * (x > 4)) for k, x in enumerate(d))
    return "".join(map(str, d)) + str(-total % 10)


def other_card(rnd):
    good = card(rnd)
    return good[:-1] + str((int(good[-1]) + rnd.randint(1, 9)) % 10)


def phone(rnd):
    area, exchange, rest = f"{rnd.randint(2, 9)}{rnd.randint(0, 8)}{rnd.randint(0, 9)}", f"{rnd.randint(2, 9)}{rnd.randint(0, 99):02d}", f"{rnd.randrange(10000):04d}"
    return rnd.choice((f"({area}) {exchange}-{rest}", f"{area}-{exchange}-{rest}"))


def hexes(rnd, n):
    return "".join(rnd.choice("0123456789abcdef") for _ in range(n))


def key(rnd):
    return rnd.choice((hexes(rnd, 40), hexes(rnd, 32), "ghp_" + hexes(rnd, 36)))


def corpus(n=900, seed=11):
    """(texts, per text the set of (kind, start, end) beyond the strict patterns)."""
    rnd = random.Random(seed)
    texts, spans = [], []
    for _ in range(n):
        out, own = "", set()

        def put(text, kind=None):
            nonlocal out
            if kind:
                own.add((kind, len(out), len(out) + len(text)))
            out += text

        def prose():
            put(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 9))) + " ")

        prose()
        what = rnd.randrange(9)
        if what == 0:
            put(rnd.choice(("mail ", "contact ", "write to ")))
            put(f"{rnd.choice(WORDS)}.{rnd.randrange(99)}{rnd.choice(('[at]', ' (at) '))}mail{rnd.randrange(9)}.example.{rnd.choice(('com', 'de', 'org'))}", "email")
        elif what == 1:
            put(rnd.choice(("call ", "phone ", "tel ")))
            put(phone(rnd), "phone")
        elif what == 2:  # two cards in one run of digits, which the strict pattern gives up
            put(card(rnd), "card")
            put(" ")
            put(card(rnd), "card")
        elif what == 3:
            put(f"token = \"")
            put(key(rnd), "secret")
            put('"')
        elif what == 4:
            put(f"api_key: ")
            put(key(rnd), "secret")
        elif what == 5:  # strict ones, so that the labelers have evidence
            put(f"mail {rnd.choice(WORDS)}@mail.example.com from 10.{rnd.randrange(256)}.3.4 card {card(rnd)} call +1 ({rnd.randint(200, 999)}) 555-{rnd.randrange(10000):04d}")
        elif what == 6:  # decoys
            put(f"number {other_card(rnd)} and {other_card(rnd)}")
        elif what == 7:
            put(f"commit {hexes(rnd, 40)} of {'-'.join(rnd.choice(WORDS) for _ in range(6))}")
        else:
            put(f"version 300.{rnd.randrange(300, 999)}.1.2 ratio 1{rnd.randint(10, 99)}-{rnd.randint(100, 199)}-{rnd.randrange(10000):04d} meet (at) noon")
        put(" ")
        prose()
        texts.append(out)
        spans.append(own)
    return texts, spans
