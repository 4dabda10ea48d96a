"""Licence notices over several lines, and inside long lines."""

from __future__ import annotations

import random
import textwrap

import pytest

from rangeframe.llm.license_scan import TEMPLATES, Scanner, scan

RNG = random.Random(2)
COMMON = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()


def prose(n: int) -> str:
    return " ".join(RNG.choice(COMMON) if RNG.random() < 0.6 else f"word{RNG.randint(0, 300)}" for _ in range(n))


@pytest.fixture(scope="module")
def scanner():
    return Scanner(TEMPLATES)


def confirmed(text, scanner):
    return [r[4] for r in scan(text, scanner) if r[9]]


@pytest.mark.parametrize("width", [40, 60, 80])
@pytest.mark.parametrize("name", ["mit", "bsd", "isc", "cc0-1.0", "gpl-3.0", "apache-2.0", "all-rights-reserved"])
def test_wrapped_notices_are_whole(scanner, name, width):
    lines = textwrap.wrap(TEMPLATES[name], width, break_on_hyphens=False, break_long_words=False)
    for mark in ("", "# ", " * "):
        notice = "\n".join(mark + line for line in lines)
        text = f"{prose(30)}\n\n{notice}\n\n{prose(30)}"
        (found,) = [r for r in scan(text, scanner) if r[9]]
        assert found[4] == name and found[6] == 1 and not found[7] and not found[8] and found[0] == 2
        assert text[found[1] : found[2]] == found[3]


def test_one_foreign_word_in_a_wrapped_notice(scanner):
    lines = textwrap.wrap(TEMPLATES["mit"], 70)
    lines[2] = "foreign " + lines[2]
    (found,) = [r for r in scan("\n".join(lines), scanner) if r[9]]
    assert found[4] == "mit" and found[8] == ["foreign"]


@pytest.mark.parametrize("size", [150, 700, 1800])
@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_notices_in_long_lines(scanner, name, size):
    for at in (0, size // 3, size):
        words = prose(size).split()
        assert confirmed(" ".join([*words[:at], TEMPLATES[name], *words[at:]]), scanner) == [name]


def test_every_notice_of_a_line(scanner):
    names = ["mit-short", "all-rights-reserved", "cc-by-nc-4.0-short", "mit-short"]
    assert confirmed(prose(40).join(" " + TEMPLATES[n] + " " for n in names), scanner) == names
