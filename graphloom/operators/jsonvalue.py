"""JSON values of any depth: numbers stay as written, and nothing recurses.

The standard decoder is used while it can; where nesting is deeper than it allows, a decoder with a
stack of its own takes over and accepts exactly the same texts.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from json.encoder import encode_basestring


class Number(str):
    """A JSON number as it is written: no digit is lost, and 1.0 is not 1."""

    __slots__ = ()


def _no_constant(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_no_constant, parse_float=Number, parse_int=Number).decode
_space = re.compile(r"[ \t\n\r]*")
_number = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
_WORDS = {"null": None, "true": True, "false": False}
_BLANK = " \t\r\n﻿"


def _decode_deep(s: str):
    """What ``_decode`` gives, for any depth."""

    def skip(at: int) -> int:
        return _space.match(s, at).end()

    def fail(at: int):
        raise ValueError(f"not JSON at {at}")

    def key(at: int) -> tuple[str, int]:
        if s[at : at + 1] != '"':
            fail(at)
        name, at = scanstring(s, at + 1, True)
        at = skip(at)
        if s[at : at + 1] != ":":
            fail(at)
        return name, skip(at + 1)

    open_: list[list] = []  # [container, key of the value being read]
    at = skip(0)
    while True:
        ch = s[at : at + 1]
        if ch == "{" or ch == "[":
            made: dict | list = {} if ch == "{" else []
            at = skip(at + 1)
            if s[at : at + 1] == ("}" if ch == "{" else "]"):
                value, at = made, at + 1
            else:
                name = None
                if ch == "{":
                    name, at = key(at)
                open_.append([made, name])
                continue
        elif ch == '"':
            value, at = scanstring(s, at + 1, True)
        elif m := _number.match(s, at):
            value, at = Number(m.group()), m.end()
        else:
            word = next((w for w in _WORDS if s.startswith(w, at)), None)
            if word is None:
                fail(at)
            value, at = _WORDS[word], at + len(word)
        while True:  # the value is whole: put it where it belongs
            at = skip(at)
            if not open_:
                if at != len(s):
                    fail(at)
                return value
            holder, name = open_[-1]
            if name is None:
                holder.append(value)
            else:
                holder[name] = value
            ch = s[at : at + 1]
            if ch == ",":
                at = skip(at + 1)
                if name is not None:
                    open_[-1][1], at = key(at)
                break
            if ch != ("]" if name is None else "}"):
                fail(at)
            value, at = open_.pop()[0], at + 1


def decode(text: str):
    """The value of a JSON text; ValueError if it is none."""
    try:
        return _decode(text)
    except RecursionError:
        return _decode_deep(text)


def parse_line(line: str | None):
    """The JSON value of a line, unwrapped once where it is a string; ValueError if it is none."""
    if line is None:
        raise ValueError("null")
    value = decode(line.strip(_BLANK))
    return decode(value.strip(_BLANK)) if isinstance(value, str) and not isinstance(value, Number) else value


def nested(value) -> bool:
    """Whether a value is an object or an array."""
    return isinstance(value, (dict, list))


def literal(value) -> str:
    """A scalar as JSON."""
    if isinstance(value, str):
        return str(value) if isinstance(value, Number) else encode_basestring(value)
    return "null" if value is None else "true" if value else "false"


def places(value) -> list[list]:
    """The objects and arrays of a value, each holder before what it holds: [place of its holder or -1, field, ordinal, itself].

    ``field`` is null for elements of arrays. Read backwards, the list runs bottom-up.
    """
    found: list[list] = [[-1, None, 0, value]]
    for at, (_, _, _, held) in enumerate(found):
        keyed = isinstance(held, dict)
        for ordinal, (name, child) in enumerate(held.items() if keyed else enumerate(held)):
            if isinstance(child, (dict, list)):
                found.append([at, name if keyed else None, ordinal, child])
    return found


def canonical_text(value) -> str:
    """JSON with sorted fields, whatever the depth."""
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]  # (whether it is text already, text or value), last first
    while todo:
        done, it = todo.pop()
        if done:
            out.append(it)
        elif isinstance(it, dict):
            todo.append((True, "}"))
            for n, (name, child) in enumerate(sorted(it.items(), key=lambda kv: kv[0], reverse=True), 1):
                todo += [(False, child), (True, ("," if n < len(it) else "") + encode_basestring(name) + ":")]
            todo.append((True, "{"))
        elif isinstance(it, list):
            todo.append((True, "]"))
            for n, child in enumerate(reversed(it), 1):
                todo += [(False, child), (True, "," if n < len(it) else "")]
            todo.append((True, "["))
        else:
            out.append(literal(it))
    return "".join(out)
