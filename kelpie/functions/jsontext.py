"""JSON text of unknown shape and depth, read strictly and without recursion limits."""

from __future__ import annotations

import json
import re


class Number(str):
    """A JSON number, kept as it was written, so that no digit is lost."""

    __slots__ = ()


class NotJson(ValueError):
    pass


def _refuse(name: str):
    raise NotJson(name)


_decoder = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)
_token = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))'
)


def parse(text: str):
    """The value of a JSON text; NotJson where it isn't valid. Objects keep the last of equal keys."""
    try:
        return _decoder.decode(text)
    except RecursionError:
        return _parse_deep(text)
    except NotJson:
        raise
    except ValueError as e:
        raise NotJson(str(e)) from None


def _parse_deep(text: str):
    """The same with a stack of its own, for texts nested deeper than the interpreter's stack."""
    root: list = []
    stack: list = [root]  # open containers
    keys: list = [None]  # the key that waits for its value, by open container
    state, at, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _token.match(text, at)
        if not m:
            raise NotJson(f"at {at}")
        at = m.end()
        sign, string, number, word = m.groups()
        if sign in ("{", "[") and state in ("value", "first"):
            new = {} if sign == "{" else []
            _put(stack, keys, new)
            stack.append(new)
            keys.append(None)
            state = "firstkey" if sign == "{" else "first"
            continue
        if sign in ("}", "]"):
            top = stack[-1]
            if len(stack) == 1 or (sign == "}") != isinstance(top, dict) or state not in ("after", "firstkey", "first"):
                raise NotJson(f"at {at}")
            stack.pop()
            keys.pop()
            state = "after"
        elif sign == "," and state == "after" and len(stack) > 1:
            state = "key" if isinstance(stack[-1], dict) else "value"
        elif sign == ":" and state == "colon":
            state = "value"
        elif string is not None and state in ("key", "firstkey"):
            keys[-1] = json.loads(string)
            state = "colon"
        elif sign is None and state in ("value", "first"):
            if string is not None:
                _put(stack, keys, json.loads(string))
            elif number is not None:
                _put(stack, keys, Number(number))
            else:
                _put(stack, keys, {"true": True, "false": False, "null": None}[word])
            state = "after"
        else:
            raise NotJson(f"at {at}")
    if len(stack) != 1 or state != "after" or len(root) != 1:
        raise NotJson("it ends early")
    return root[0]


def _put(stack: list, keys: list, value) -> None:
    top = stack[-1]
    if isinstance(top, dict):
        top[keys[-1]] = value
    else:
        top.append(value)


def denoted(text: str | None):
    """The value a metadata text stands for: a text that was turned into text again is read until it is no JSON string.

    None for null, for texts that aren't valid JSON, and for strings that hold no further JSON text.
    """
    value = text
    while type(value) is str:
        try:
            value = parse(value)
        except NotJson:
            return None
    return value
