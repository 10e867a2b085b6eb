"""Strict JSON reading without a depth limit."""

from __future__ import annotations

import json
import re


class NotJson(ValueError):
    """The text is not one complete JSON value."""


def _no_constant(name: str):
    raise NotJson(name)


_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\]:,]|"(?:[^"\\\x00-\x1f]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)')


def _loads_deep(text: str):
    """One JSON value, read with a stack of our own: for texts nested deeper than the interpreter recurses."""
    at, end = 0, len(text.rstrip(" \t\n\r"))
    holders: list = []
    keys: list = []
    done, result, want = False, None, "value"
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or done:
            raise NotJson("no token")
        token, at = m.group(1), m.end()
        closed = None
        if want in ("value", "value or ]") and token in "{[":
            holders.append({} if token == "{" else [])
            keys.append(None)
            want = "key or }" if token == "{" else "value or ]"
            continue
        if (token == "]" and want in ("value or ]", ", or ]")) or (token == "}" and want in ("key or }", ", or }")):
            closed = holders.pop()
            keys.pop()
        elif want in ("key", "key or }") and token[0] == '"':
            keys[-1], want = json.loads(token), ":"
            continue
        elif want == ":" and token == ":":
            want = "value"
            continue
        elif want in (", or ]", ", or }") and token == ",":
            want = "value" if want == ", or ]" else "key"
            continue
        elif want in ("value", "value or ]") and token not in "{}[]:,":
            closed = json.loads(token)
        else:
            raise NotJson(f"{token} where {want} belongs")
        if not holders:
            done, result = True, closed
        elif isinstance(holders[-1], list):
            holders[-1].append(closed)
            want = ", or ]"
        else:
            holders[-1][keys[-1]] = closed
            want = ", or }"
    if not done:
        raise NotJson("incomplete")
    return result


def loads(text: str):
    """The value of a complete JSON text; NotJson for anything else. Of equal keys in one object the last counts."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _loads_deep(text)
    except NotJson:
        raise
    except ValueError as e:
        raise NotJson(str(e)) from None
