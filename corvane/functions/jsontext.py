"""Strict JSON reading that keeps numbers as written and sets no limit on depth."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


class Number(str):
    """A JSON number in its own spelling."""

    __slots__ = ()


def _constant(_: str):
    raise ValueError("not JSON")


def parse(text: str):
    """The value of a JSON text; ValueError where it is not valid JSON."""
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_constant)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """As `parse`, with a stack of its own instead of recursion."""
    root: list = []
    stack: list = [(root, None)]  # container, pending key
    pos = _SPACE.match(text).end()
    expect_value = True
    while True:
        holder, key = stack[-1]
        if expect_value:
            head = text[pos : pos + 1]
            if head in "{[" and head:
                value = {} if head == "{" else []
                _put(holder, key, value)
                stack.append((value, None))
                pos = _SPACE.match(text, pos + 1).end()
                if text[pos : pos + 1] == ("}" if head == "{" else "]"):
                    stack.pop()
                    pos = _SPACE.match(text, pos + 1).end()
                    expect_value = False
                elif head == "{":
                    pos = _key(text, pos, stack)
                continue
            if head == '"':
                value, pos = scanstring(text, pos + 1, True)
            else:
                atom = _ATOM.match(text, pos)
                if not atom:
                    raise ValueError(f"not JSON at {pos}")
                value, pos = _WORDS[atom[0]] if atom[0] in _WORDS else Number(atom[0]), atom.end()
            _put(holder, key, value)
            pos = _SPACE.match(text, pos).end()
            expect_value = False
            continue
        if len(stack) == 1:
            if pos != len(text):
                raise ValueError(f"not JSON at {pos}")
            return root[0]
        sign = text[pos : pos + 1]
        if sign == ",":
            pos = _SPACE.match(text, pos + 1).end()
            if isinstance(holder, dict):
                pos = _key(text, pos, stack)
            expect_value = True
        elif sign == ("}" if isinstance(holder, dict) else "]"):
            stack.pop()
            pos = _SPACE.match(text, pos + 1).end()
        else:
            raise ValueError(f"not JSON at {pos}")


def _put(holder, key, value) -> None:
    if isinstance(holder, dict):
        holder[key] = value
    else:
        holder.append(value)


def _key(text: str, pos: int, stack: list) -> int:
    if text[pos : pos + 1] != '"':
        raise ValueError(f"not JSON at {pos}")
    key, pos = scanstring(text, pos + 1, True)
    pos = _SPACE.match(text, pos).end()
    if text[pos : pos + 1] != ":":
        raise ValueError(f"not JSON at {pos}")
    stack[-1] = (stack[-1][0], key)
    return _SPACE.match(text, pos + 1).end()
