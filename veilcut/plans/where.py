"""Safety check of a root predicate before it reaches the engine."""

from __future__ import annotations

_WHY = {";": "a semicolon", "\\": "a backslash", "$": "a dollar sign"}


def check_predicate(text: str, deepest: int = 6) -> tuple[int, str] | None:
    """None if the predicate may run, else (1-based position, reason).

    Quoted text is skipped.  Refused: `;`, backslash, `$`, comments, brackets that are unbalanced or nested deeper than
    `deepest`, an open quote and a minus or slash at the end.
    """
    depth, i, opened = 0, 0, []
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if c in _WHY:
            return i + 1, _WHY[c]
        if c in "'\"":
            end = i + 1
            while True:
                end = text.find(c, end)
                if end < 0:
                    return i + 1, "an open quote"
                inside = text[i + 1 : end]
                for bad, why in _WHY.items():
                    if bad in inside:
                        return i + 2 + inside.index(bad), why
                if text[end + 1 : end + 2] != c:
                    break
                end += 2
            i = end + 1
            continue
        if two in ("--", "/*", "*/"):
            return i + 1, "a comment"
        if c == "(":
            depth += 1
            opened.append(i)
            if depth > deepest:
                return i + 1, "brackets nested too deep"
        elif c == ")":
            depth -= 1
            if depth < 0:
                return i + 1, "a closing bracket without an opening one"
            opened.pop()
        i += 1
    if depth:
        return opened[-1] + 1, "an opening bracket without a closing one"
    bare = text.rstrip()
    if bare[-1:] in ("-", "/"):
        return len(bare), "an operator at the end"
    return None
