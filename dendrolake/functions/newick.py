"""Newick text: check, parse, print. Small helpers that run on one text at a time inside Spark tasks."""

from __future__ import annotations

import re

#: Taxa of a word of a split's bit mask.
WORD = 62

_TOKEN = re.compile(r"[(),;]|:\s*[^(),;:\s]+|[^(),;:\s]+")


def words(mask: int, taxa: int) -> list[int]:
    """A mask as words of 62 bits."""
    return [mask >> s & (1 << WORD) - 1 for s in range(0, max(taxa, 1), WORD)]


def joined(parts: list[int]) -> int:
    return sum(int(w) << WORD * i for i, w in enumerate(parts))


def check(text: str | None) -> str:
    """``ok`` or what is wrong: brackets that don't balance, a bracket pair without a comma at its level, or a closing
    bracket that neither ends the text nor has a length or comma or bracket after it."""
    if not text or "(" not in text:
        return "no tree"
    body = text[text.index("(") :].strip().removesuffix(";").rstrip()
    commas: list[int] = []
    closed = False
    for i, c in enumerate(body):
        if closed and not commas and c == "(":
            return "text after end"
        if c == "(":
            commas.append(0)
        elif c == "," and commas:
            commas[-1] += 1
        elif c == ")":
            if not commas:
                return "unbalanced"
            if not commas.pop():
                return "no comma"
            closed = True
            if i + 1 < len(body) and body[i + 1] != ":":
                return "no length"
    return "unbalanced" if commas else "ok"


def parse(text: str | None, bits: dict[str, int], keep_zero: bool = False) -> tuple[list[tuple[int, float]], dict[int, float]]:
    """Interior edges as (mask, length) and leaf lengths by taxon. Edges of length 0 are left out unless kept. A text that
    is no tree of these labels raises ValueError."""
    if not text or "(" not in text:
        raise ValueError("no tree")
    stack: list[int] = [0]
    splits: list[tuple[int, float]] = []
    leaves: dict[int, float] = {}
    last: tuple[str, int] | None = None
    for token in _TOKEN.findall(text[text.index("(") :]):
        if token == "(":
            stack.append(0)
            last = None
        elif token == ")":
            if len(stack) < 2:
                raise ValueError("unbalanced")
            mask = stack.pop()
            stack[-1] |= mask
            last = ("split", mask)
            splits.append((mask, 0.0))
        elif token == ",":
            last = None
        elif token == ";":
            break
        elif token[0] == ":":
            length = float(token[1:])
            if last and last[0] == "split":
                splits[-1] = (last[1], length)
            elif last:
                leaves[last[1]] = length
        elif last is None:  # a name after a bracket is the node's own
            if token not in bits:
                raise ValueError(f"unknown label {token}")
            bit = bits[token]
            stack[-1] |= 1 << bit
            leaves[bit] = 0.0
            last = ("leaf", bit)
    if len(stack) > 1:
        raise ValueError("unbalanced")
    whole = stack[0]
    return [(m, x) for m, x in splits if m != whole and (keep_zero or x > 0)], leaves


def render(splits: list[tuple[int, float]], leaves: dict[int, float], labels: list[str], lengths: bool = True) -> str:
    """Newick text; children stand by their smallest taxon."""
    text: dict[int, tuple[int, str]] = {
        1 << t: (t, f"{labels[t]}:{x!r}" if lengths else labels[t]) for t, x in sorted(leaves.items())
    }
    for mask, x in sorted(splits, key=lambda s: (s[0].bit_count(), s[0])):
        own = [m for m in text if m & mask == m]
        parts = sorted(text.pop(m) for m in own)
        inner = ",".join(p for _, p in parts)
        text[mask] = (parts[0][0], f"({inner}):{x!r}" if lengths else f"({inner})")
    return "(" + ",".join(p for _, p in sorted(text.values())) + ");"


def resolve(splits: list[tuple[int, float]], leaves: dict[int, float]) -> list[tuple[int, float]]:
    """Splits of length 0 that make a ladder of each node's children after the first: larger clades first, then names."""
    known = [m for m, _ in splits]
    whole = sum(1 << t for t in leaves)
    added = []
    for mask in [*known, whole]:
        inside = [m for m in known if m != mask and m & mask == m]
        top = [m for m in inside if not any(m != o and m & o == m for o in inside)]
        covered = sum(top)
        children = sorted([*top, *(1 << t for t in leaves if 1 << t & mask and not 1 << t & covered)], key=lambda m: (-m.bit_count(), m))
        run = children[1] if len(children) > 2 else 0
        for child in children[2:]:
            run |= child
            added.append((run, 0.0))
    return [*splits, *added]
