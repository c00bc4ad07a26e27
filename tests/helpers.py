"""Seeded generators; tokens are put together at run time."""

import random

from redactlake.functions.checks import ID_CHECK, ID_WEIGHTS, USCC_ALPHABET, USCC_WEIGHTS

RNG = random.Random(5)
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def some(n, alphabet=ALNUM):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def github():
    return "gh" + "p_" + some(36)


def identity(first17):
    return first17 + ID_CHECK[sum(int(c) * w for c, w in zip(first17, ID_WEIGHTS)) % 11]


def company(first17):
    return first17 + USCC_ALPHABET[(31 - sum(USCC_ALPHABET.index(c) * w for c, w in zip(first17, USCC_WEIGHTS)) % 31) % 31]


def luhn_ok(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card(first):
    return next(first + str(d) for d in range(10) if luhn_ok(first + str(d)))
