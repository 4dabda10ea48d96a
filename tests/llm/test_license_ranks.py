"""Compression ranks the templates; the wording confirms, and decides only between equal savings."""

from __future__ import annotations

import random

from rangeframe.llm import license_scan
from rangeframe.llm.license_scan import LEAST_WORDS, TEMPLATES, Scanner, scan

RNG = random.Random(8)
WORDS = [f"{a}{b}" for a in ("lorp", "mirt", "sand", "quel", "drav") for b in ("en", "ist", "ock", "ume", "aly")]


def names(text, scanner):
    return [r[4] for r in scan(text, scanner) if r[9]]


def test_saving_decides_between_equal_wordings():
    short = WORDS[:9] + ["license"]
    long = WORDS[:9] + ["license"] + WORDS[10:12] + ["absent", "missing"]
    scanner = Scanner({"z-short": " ".join(short), "a-long": " ".join(long)})
    text = " ".join(short + WORDS[10:12])
    # both wordings count ten, and the name would favour the short one
    for name, words in scanner.templates.items():
        share, _, _, missing, foreign = scanner.compared(name, tuple(text.split()))
        assert share >= LEAST_WORDS and len(words) - 2 * len(missing) - len(foreign) == 10
    assert scanner.reduction("a-long", tuple(text.split())) > scanner.reduction("z-short", tuple(text.split()))
    assert names(text, scanner) == ["a-long"]


def test_the_first_confirmed_of_the_ranking_wins():
    """Against every template compressed and compared plainly, on edited notices among other words."""
    scanner = Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        for _ in range(6):
            words = text.lower().split()
            for at in RNG.sample(range(len(words)), len(words) // 10):
                words[at] = RNG.choice(WORDS)
            have = license_scan._tokens(" ".join(RNG.choices(WORDS, k=9) + words + RNG.choices(WORDS, k=9)))
            cue = RNG.randrange(9, len(have) - 9)
            offers = []
            for other, want in scanner.templates.items():
                reach = len(want) + len(want) // 4 + 4
                window = tuple(have[max(0, cue - reach) : cue + reach + 1])
                content = " ".join(window).encode()
                saved = len(scanner._alone.compress(content)) - len(scanner._worded[other].compress(content))
                share, _, _, missing, foreign = scanner._compared(other, window)
                if share >= LEAST_WORDS:
                    offers.append((saved, len(want) - 2 * len(missing) - len(foreign), other))
            best = license_scan._best(scanner, have, cue, 0, len(have), True)
            assert (best and best[0]) == max(offers, default=None)


def test_a_template_that_ranks_low_is_still_confirmed():
    scanner = Scanner(TEMPLATES)
    grant = TEMPLATES["mit"].lower().split()
    torn = " ".join(" ".join(grant[i : i + 6]) + " " + " ".join(RNG.choices(WORDS, k=4)) for i in range(0, 36, 6))
    text = torn + " all rights reserved. " + torn
    have = license_scan._tokens(text)
    cue = have.index("reserved")
    window = lambda name: tuple(have[max(0, cue - 2 * len(scanner.templates[name])) : cue + 2 * len(scanner.templates[name])])
    assert scanner.reduction("mit", window("mit")) > scanner.reduction("all-rights-reserved", window("all-rights-reserved"))
    assert "all-rights-reserved" in names(text, scanner)
