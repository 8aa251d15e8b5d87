"""What a column admits, read from its type, labels and CHECK texts; the common masker of columns that must stay equal."""

from __future__ import annotations

from ..model import Column
from .generators import MASKERS, Limits, required

_SIGNS = ("<=", ">=", "<>", "!=", "::", "=", "<", ">", "(", ")", "[", "]", ",")


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value) of a SQL expression: word (in lower case), name (quoted), string, number or sign; casts are dropped."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c in "'\"":
            j, held = i + 1, ""
            while j < len(text) and (text[j] != c or text[j + 1 : j + 2] == c):
                held += text[j]
                j += 1 + (text[j] == c)
            out.append(("string" if c == "'" else "name", held))
            i = j + 1
        elif c.isalnum() or c == "_":
            j = i
            while j < len(text) and (text[j].isalnum() or text[j] in "_."):
                j += 1
            word = text[i:j].lower()
            out.append(("number" if word.replace(".", "", 1).isdigit() else "word", word))
            i = j
        else:
            sign = next((x for x in _SIGNS if text.startswith(x, i)), None)
            if sign:
                out.append(("sign", sign))
            i += len(sign or " ")
    return _without_casts(out)


def _without_casts(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(found):
        if found[i] != ("sign", "::"):
            out.append(found[i])
            i += 1
            continue
        i += 1  # the type: words, then (n) or [] behind them
        while i < len(found) and found[i][0] == "word" and found[i][1] not in ("and", "or", "in", "not", "any"):
            i += 1
        while i + 1 < len(found) and found[i] == ("sign", "[") and found[i + 1] == ("sign", "]"):
            i += 2
        if i + 2 < len(found) and found[i] == ("sign", "(") and found[i + 1][0] == "number" and found[i + 2] == ("sign", ")"):
            i += 3
    return out


def _clauses(found: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The parts that AND joins outside of parentheses; parentheses around all of a part are taken off."""
    while found and found[0] == ("sign", "(") and _closing(found, 0) == len(found) - 1:
        found = found[1:-1]
    parts, depth, last = [], 0, 0
    for i, t in enumerate(found):
        depth += (t in (("sign", "("), ("sign", "["))) - (t in (("sign", ")"), ("sign", "]")))
        if not depth and t == ("word", "and"):
            parts.append(found[last:i])
            last = i + 1
    parts.append(found[last:])
    return parts if len(parts) == 1 else [c for x in parts for c in _clauses(x)]


def _closing(found: list[tuple[str, str]], at: int) -> int:
    depth = 0
    for i in range(at, len(found)):
        depth += (found[i] == ("sign", "(")) - (found[i] == ("sign", ")"))
        if not depth:
            return i
    return len(found)


def _listed(clause: list[tuple[str, str]]) -> tuple[str, ...]:
    """The strings of `column IN (...)`, `column = ANY (ARRAY[...])` or `column = '...'`; none for a clause of another form or a negated one."""
    words = [v for k, v in clause if k == "word"]
    if "not" in words or "or" in words or any(t in (("sign", "<>"), ("sign", "!=")) for t in clause):
        return ()
    isin = ("word", "in") in clause or ("word", "any") in clause and ("sign", "=") in clause
    equal = [k for k, _ in clause if k != "sign"] in (["word", "string"], ["name", "string"]) and ("sign", "=") in clause
    return tuple(v for k, v in clause if k == "string") if isin or equal else ()


def check_labels(check: str) -> tuple[str, ...]:
    """The values that a CHECK allows: those all its listing clauses share; clauses that are negated or of other forms add no limit."""
    labels: tuple[str, ...] = ()
    for clause in _clauses(tokens(check)):
        if own := _listed(clause):
            labels = tuple(x for x in labels if x in own) if labels else own
    return labels


def check_length(check: str) -> tuple[int | None, int | None]:
    """(exact, most) lengths that a CHECK sets: clauses `length(column) op number`."""
    exact = most = None
    for clause in _clauses(tokens(check)):
        kinds, values = [k for k, _ in clause], [v for _, v in clause]
        if len(clause) < 5 or values[0] not in ("length", "char_length", "octet_length") or kinds[-1] != "number" or values[1] != "(" or values[-3] != ")":
            continue
        n = int(float(values[-1]))
        if values[-2] == "=":
            exact = n
        elif values[-2] in ("<", "<="):
            most = min(x for x in (most, n - (values[-2] == "<")) if x is not None)
    return exact, most


def limits_of(column: Column, unique: bool = False, role: str = "full") -> Limits:
    """Limits of a column: declared labels or those every CHECK allows, lengths, null and uniqueness."""
    labels, exact, most = column.labels, None, column.max_len
    for check in column.checks:
        own = check_labels(check)
        labels = tuple(x for x in labels if x in own) if labels and own else labels or own
        e, m = check_length(check)
        exact = e if e is not None else exact
        most = min(x for x in (most, m) if x is not None) if (most is not None or m is not None) else None
    return Limits(max_len=most, labels=labels, exact_len=exact, nullable=column.nullable, unique=unique, role=role, kind=column.type)


def common_limits(columns: list[Column]) -> Limits | None:
    """Limits that all columns of an equality group admit; None if they contradict each other."""
    each = [limits_of(c) for c in columns]
    labelled = [set(x.labels) for x in each if x.labels]
    labels = tuple(sorted(set.intersection(*labelled))) if labelled else ()
    exact = {x.exact_len for x in each if x.exact_len is not None}
    most = [x.max_len for x in each if x.max_len is not None]
    if (labelled and not labels) or len(exact) > 1 or (exact and most and min(most) < min(exact)):
        return None
    return Limits(max_len=min(most) if most else None, labels=labels, exact_len=min(exact) if exact else None, nullable=all(x.nullable for x in each))


def group_masker(category: str, columns: list[Column], distinct: int, unique: bool) -> tuple[str, Limits] | str:
    """The masker and limits of an equality group, or why there is none."""
    limits = common_limits(columns)
    if limits is None:
        return "its columns admit no common value"
    if limits.labels and unique and len(limits.labels) < distinct:
        return f"{len(limits.labels)} labels can't keep {distinct} values apart"
    own = sorted(((d, n) for n, (c, _, d) in MASKERS.items() if c == category), key=lambda x: x[0])
    for domain, name in own:
        if not unique or domain >= required(distinct):
            return name, limits
    return f"no masker of {category} keeps {distinct} values apart"
