"""Streaming a JSON record as (path, value, ordinals) triples, without building it.

:func:`stream` reads the text once from left to right and emits a triple for each scalar as it passes it; what it
holds is the chain of open objects and lists, nothing of what it has read.  A record counts only if it is complete,
so its triples are handed over when its end is reached.

A path is the chain of keys from the top; lists add nothing to it.  Paths are nodes of a tree kept per task, so a
triple carries a reference and not a string, and what is known about a path is looked up once.  Each list a scalar is
in adds an ordinal: (ordinal of the list around it or None, path of the list, place from 1).

Defined results: a text that is not one complete JSON value gives None, and so does one that is no object or list; a
text encoded again as a string, however often, is unwrapped; depth and length are bounded by memory only; a key that
comes twice in an object gives its values twice; numbers are kept as they are written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

TEXT, NUMBER, BOOLEAN = 1, 2, 4

_S = "[ \t\n\r]*+"
_PLAIN = '"([^"\\\\\x00-\x1f]*+)"'
_space = re.compile(_S).match
#: The usual member, a key and a text without escapes, with what follows it.
_member = re.compile(f"{_PLAIN}{_S}:{_S}{_PLAIN}{_S}([,}}]){_S}").match
_key = re.compile(f"{_PLAIN}{_S}:{_S}").match
_scalar = re.compile(f"{_PLAIN}|(-?(?:0|[1-9][0-9]*+)(?:\\.[0-9]++)?(?:[eE][-+]?[0-9]++)?)|(true)|(false)|(null)|(NaN|-?Infinity)").match
_after = re.compile(f"{_S}([],}}]){_S}").match


class PathNode:
    """A path: its last key and its parent; ``role`` is what the task has found out about it."""

    __slots__ = ("key", "parent", "children", "role", "_text")

    def __init__(self, key: str = "", parent: PathNode | None = None):
        self.key, self.parent, self.children, self.role, self._text = key, parent, {}, None, None

    def child(self, key: str) -> PathNode:
        node = self.children.get(key)
        if node is None:
            node = self.children[key] = PathNode(key, self)
        return node

    def up(self) -> Iterator[PathNode]:
        """The path and the paths above it, but for the empty one."""
        node = self
        while node.parent is not None:
            yield node
            node = node.parent

    @property
    def text(self) -> str:
        """The keys joined by dots."""
        if self._text is None:
            self._text = ".".join([n.key for n in self.up()][::-1])
        return self._text


class Numeral(str):
    """A JSON number as it is written."""

    __slots__ = ()


class Incomplete(ValueError):
    """The text is not one complete JSON value."""


def _string(text: str, at: int) -> tuple[str, int]:
    """The string that begins at ``at`` and where it ends."""
    if text[at : at + 1] != '"':
        raise Incomplete
    return scanstring(text, at + 1, True)


def stream(text: str, root: PathNode) -> Iterator[tuple]:
    """(node, value, ordinals) of every scalar, nulls too, in document order; raises :class:`Incomplete` or ValueError
    where the text goes wrong.  A scalar at the top is a triple of ``root``."""
    at, n = _space(text, 0).end(), len(text)
    node, ords = root, None
    # the open containers around the current one; a list's place is None for an object
    stack: list[tuple] = []
    here, outer, place = root, None, None  # path, ordinal around and place in the current container
    opened = False
    while True:
        # a value begins at ``at``, with path ``node`` and ordinal ``ords``
        c = text[at : at + 1]
        if c == "{" or c == "[":
            if opened:
                stack.append((here, outer, place))
            opened = True
            here, outer, place = node, ords, None if c == "{" else 0
            at = _space(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                mark = ","
            else:
                mark, at = text[at], _space(text, at + 1).end()
        else:
            m = _scalar(text, at)
            if m:
                kind = m.lastindex
                value = m[1] if kind == 1 else Numeral(m[2]) if kind == 2 else True if kind == 3 else False if kind == 4 else None if kind == 5 else Numeral(m[6])
                at = m.end()
            else:
                value, at = _string(text, at)
            yield node, value, ords
            if not opened:
                break
            m = _after(text, at)
            if not m:
                raise Incomplete
            mark, at = m[1], m.end()
        while True:
            if mark == ",":
                if place is not None:
                    place += 1
                    node, ords = here, (outer, here, place)
                    break
                ords = outer
                m = _member(text, at)
                while m:
                    key = m[1]
                    yield here.children.get(key) or here.child(key), m[2], ords
                    mark, at = m[3], m.end()
                    if mark != ",":
                        break
                    m = _member(text, at)
                if mark == ",":
                    m = _key(text, at)
                    if m:
                        key, at = m[1], m.end()
                    else:
                        key, at = _string(text, at)
                        at = _space(text, at).end()
                        if text[at : at + 1] != ":":
                            raise Incomplete
                        at = _space(text, at + 1).end()
                    node = here.children.get(key) or here.child(key)
                    break
            if (mark == "}") != (place is None):
                raise Incomplete
            if not stack:
                opened = False
                break
            here, outer, place = stack.pop()
            m = _after(text, at)
            if not m:
                raise Incomplete
            mark, at = m[1], m.end()
        if not opened:
            break
    if _space(text, at).end() != n:
        raise Incomplete


def triples(text: str | None, root: PathNode) -> list[tuple] | None:
    """The triples of a complete record, unwrapped where it was encoded again as a string; None otherwise."""
    while isinstance(text, str):
        text = text.lstrip("\ufeff")
        try:
            found = list(stream(text, root))
        except ValueError:
            return None
        if not (found and found[0][0] is root and found[0][2] is None):
            return found
        text = None if isinstance(found[0][1], Numeral) else found[0][1]
    return None


def ordinal(ords: tuple | None, node: PathNode) -> int:
    """The place in the innermost list at ``node``; 1 where there is none, as an object counts as a list of one."""
    while ords is not None:
        if ords[1] is node:
            return ords[2]
        ords = ords[0]
    return 1


def places(ords: tuple | None) -> tuple:
    """The ordinals as ((path, place), ...), outermost first."""
    out = []
    while ords is not None:
        out.append(ords[1:])
        ords = ords[0]
    return tuple(out[::-1])


def scalar_type(v) -> int:
    """TEXT, NUMBER or BOOLEAN, 0 for null."""
    if v is None:
        return 0
    if isinstance(v, bool):
        return BOOLEAN
    return NUMBER if isinstance(v, (Numeral, int, float)) else TEXT
