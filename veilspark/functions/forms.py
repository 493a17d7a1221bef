"""Patterns made from written examples.

Examples show which separators stand in which place; a separator stands for all of its kind, and a place that is empty in
some example may be empty. What an example cannot show (what must not stand beside a match) is said where a form is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Separators that stand for each other in writing and in character recognition, as parts of character classes.
KINDS = [r".,·", r"\-‐‑‒–—−", r"\s"]


def kinds(seen: Iterable[str]) -> str:
    """Character class of the kinds of all separators seen."""
    marks = {c for s in seen for c in s}
    own = [k for k in KINDS if any(re.match(f"[{k}]", c) for c in marks)]
    return f"[{''.join(own)}]"


def optional(part: str, seen: Iterable[str]) -> str:
    return f"{part}?" if "" in set(seen) else part


def checked_number(examples: list[str], check: str) -> str:
    """Pattern of numbers in groups of three with a check character, read from their ends: the character, the gap before it,
    and groups with what stands between them. In the gap before the check character, marks may have spaces around them."""
    gaps, tails, heads = set(), set(), set()
    for e in examples:
        tail, body = e[-2::-1], ""
        tail = re.match(r"[^0-9]*", tail)[0]
        body = e[: len(e) - 1 - len(tail)]
        last = re.search(r"([^0-9]?)([0-9]{3})([^0-9]?)([0-9]{3})$", body)
        gaps |= {last[1], last[3]}
        heads.add(last.start())
        tails.add(tail[::-1])
    between = optional(kinds(gaps), gaps)
    marks = {t.strip() for t in tails}
    before = optional(kinds(marks), marks)
    return rf"[0-9]{{{min(heads)},{max(heads)}}}(?:{between}[0-9]{{3}}){{2}}\s?{before}\s?[{check}]"


def spelled(word: str) -> str:
    """A short form with or without dots and spaces between its letters."""
    return r"\s?".join(rf"{c}\.?" for c in word)


def alone(pattern: str, before: str = "", after: str = "") -> str:
    """The pattern where none of the characters stands right before or after it."""
    return (f"(?<![{before}])" if before else "") + pattern + (f"(?![{after}])" if after else "")


def address(local: str, signs: str, words: list[str], label: str, dots: str, top: tuple[int, int]) -> str:
    """E-mail address: a name, an at sign or a word in its place, labels each with a dot, and a top label of letters."""
    spoken = "|".join(words)
    at = rf"(?:[{signs}]|[\[(](?:{spoken})[\])]|\s{words[-1]}\s)"
    return rf"[{local}]+\s?{at}\s?(?:[{label}]+\s?[{dots}]\s?)+[a-z]{{{top[0]},{top[1]}}}"
