"""Bracket handling in plain Python, against which tests hold the column functions."""

from __future__ import annotations

import re

from weftgraph.functions.symbols import HASH, ROOT
from weftgraph.schemas import SCOPE_STD_OWNERS


def _partners(name: str) -> dict[int, int]:
    """Closing place of every opening bracket that has one."""
    stack, pairs = [], {}
    for i, c in enumerate(name):
        if c == "<":
            stack.append(i)
        elif c == ">" and stack:
            pairs[stack.pop()] = i
    return pairs


def owner_of(name: str | None) -> str | None:
    """Crate that owns a function: the path root, or the first non-standard root inside a leading ``<...>``."""
    if not name or "::" not in name:
        return None
    if name[0] != "<":
        found = re.match(ROOT, name)
        return found[1] if found else None
    end = _partners(name).get(0)
    roots = re.findall(ROOT, name[1:end]) if end is not None else []
    return next((r for r in roots if r not in SCOPE_STD_OWNERS), roots[0] if roots else None)


def keep_impl_target(name: str) -> str:
    """``::<impl T for U>`` as ``::impl_for=U`` and ``::<impl U>`` as ``::impl=U``; text after an unclosed one as it is."""
    pairs, out, at = _partners(name), [], 0
    while (mark := name.find("::<", at)) >= 0:
        end = pairs.get(mark + 2)
        if end is None:
            break
        inner = name[mark + 3 : end]
        out.append(name[at:mark])
        if inner.startswith("impl "):
            head, split, target = inner.rpartition(" for ")
            out.append(f"::impl_for={target}" if split else f"::impl={inner[5:]}")
        else:
            out.append(name[mark : end + 1])
        at = end + 1
    return "".join(out) + name[at:]


def drop_turbofish(name: str) -> str:
    """Without balanced ``::<...>``; an unclosed one takes the rest with it."""
    pairs, out, at = _partners(name), [], 0
    while (mark := name.find("::<", at)) >= 0:
        out.append(name[at:mark])
        at = pairs.get(mark + 2, len(name) - 1) + 1
    return "".join(out) + name[at:]


class Span:
    """A closed pair of brackets: its places, whether ``::`` stands before it and a cast directly inside, its parent."""

    __slots__ = ("at", "end", "turbo", "casts", "parent")

    def __init__(self, at: int, turbo: bool, parent: Span | None):
        self.at, self.end, self.turbo, self.casts, self.parent = at, -1, turbo, False, parent


_MARKS = re.compile(r"[<>]| as ")


def _spans(name: str) -> list[Span]:
    """Spans in the order of their opening brackets. Brackets that never close are text; they can't lie in a span."""
    found: list[Span] = []
    inside: Span | None = None
    for mark in _MARKS.finditer(name):
        if mark[0] == "<":
            inside = Span(mark.start(), name[: mark.start()].endswith("::"), inside)
            found.append(inside)
        elif inside is not None:
            if mark[0] == ">":
                inside.end, inside = mark.start(), inside.parent
            else:
                inside.casts = True
    return [s for s in found if s.end >= 0]


def drop_displayed_generics(name: str) -> str:
    """Without generic arguments. A span is shown if it stands first in the name or in a shown span, or holds a cast."""
    shown: set[Span] = set()
    pieces, done = [], 0
    for span in _spans(name):
        outer = span.parent if span.parent is not None and span.parent.end >= 0 else None
        if outer is not None and outer not in shown:
            continue
        if not span.turbo and (span.casts or span.at == (outer.at + 1 if outer else 0)):
            shown.add(span)
        else:
            pieces.append(name[done : span.at - 2 * span.turbo])
            done = span.end + 1
    return "".join(pieces) + name[done:]


def _origin(drop_arguments):
    """Names without hash, with the target of an impl spelled out, and without generic arguments in the given sense."""

    def origin(name: str) -> str:
        hashed = re.search(HASH, name)
        return drop_arguments(keep_impl_target(name[: hashed.start()] if hashed else name))

    return origin


origin_of, catalog_origin_of = _origin(drop_turbofish), _origin(drop_displayed_generics)


def outside_brackets(name: str) -> str:
    """The text outside brackets, without the colons that are left at its ends; an open bracket hides all that follows."""
    hashed = re.search(HASH, name)
    name = name[: hashed.start()] if hashed else name
    pairs, out, at = _partners(name), [], 0
    while (mark := name.find("<", at)) >= 0:
        out.append(name[at:mark])
        at = pairs.get(mark, len(name)) + 1
    return "".join([*out, name[at:]]).replace("::::", "::").strip(":")
