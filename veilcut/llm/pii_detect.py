"""Detection of personal data and secrets in a text: mentions with class, normal form and, for names, the role seen.

A mention's class and normal form name its entity: all names are of class `name` whatever their role, and a number
of the North American plan has one form with and without +1.  Names are known by lists, titles and the words beside
them; a name found once in a text is found in all of it, in any case of letters that a name takes (Smith, SMITH).
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .wordlists import GIVEN_FEMALE, GIVEN_MALE, SURNAMES


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    canon: str
    role: str = ""  # of a name: f or m for given names, s for surnames


CYRILLIC_FEMALE = ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана", "Юлия", "Дарья")
CYRILLIC_MALE = ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Михаил", "Николай", "Андрей", "Павел", "Борис")
CYRILLIC_SURNAMES = ("Иванов", "Петров", "Сидоров", "Смирнов", "Кузнецов", "Попов", "Соколов", "Лебедев", "Козлов", "Новиков")
#: lists of given names and surnames by (script, class)
NAMES = {
    ("latin", "f"): GIVEN_FEMALE, ("latin", "m"): GIVEN_MALE, ("latin", "s"): SURNAMES,
    ("cyrillic", "f"): CYRILLIC_FEMALE, ("cyrillic", "m"): CYRILLIC_MALE, ("cyrillic", "s"): CYRILLIC_SURNAMES,
}
_GIVEN = {w: (script, c) for (script, c), words in NAMES.items() if c != "s" for w in words}
_SURNAME = {w: script for (script, c), words in NAMES.items() if c == "s" for w in words}
_FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа")
_TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Г-н", "Г-жа")

_LOCAL = re.compile(r"[A-Za-z0-9._%+\-]{1,64}\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)")
_CARD = re.compile(r"(?<![\d+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]?\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)")
_SSN = re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
_PHONE = re.compile(
    r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
)
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
_KEY = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bghp_[A-Za-z0-9]{36}\b")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b\s*[:=]\s*(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"',;]{6,}))")
_TITLED = re.compile(r"\b[^\W\d_]+(?:[’'-][^\W\d_]+)*")


_TWO = re.compile(r"[A-ZÀ-ÞА-ЯЁ][a-zß-ÿа-яё-]+\.? [A-ZÀ-ÞА-ЯЁ][^\W\d_]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _only_digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _capital(w: str) -> bool:
    return len(w) > 1 and w[0].isupper() and w[1:].islower()


def _as_name(w: str) -> str | None:
    """The word as a name is written in lists, or None: `Smith`, and `SMITH` if that is a listed name."""
    if _capital(w):
        return w
    if len(w) > 1 and w.isupper() and ((x := w.capitalize()) in _GIVEN or x in _SURNAME):
        return x
    return None


def _names(text: str) -> list[Mention]:
    """Titles with names after them; known given names with a name after them; in the same text, all these names alone.

    A capitalised word inside a sentence right before a name that is only a surname is taken as a given name.
    """
    if not _TWO.search(text):
        return []
    found: dict[int, Mention] = {}
    roles: dict[str, str] = {}
    words = [m for m in _TITLED.finditer(text) if m[0][0].isupper()]
    beside = lambda a, b: text[a.end() : b.start()] == " "

    def add(w: re.Match, role: str) -> None:
        canon = w[0].lower()
        found[w.start()] = Mention(w.start(), w.end(), "name", canon, role)
        if roles.get(canon, "s") == "s":
            roles[canon] = role

    k = 0
    while k < len(words):
        m = words[k]
        k += 1
        run = []
        if m[0] in _TITLES:
            last = m.end() + (text[m.end() : m.end() + 1] == ".")
            j = k
            while j < len(words) and len(run) < 3 and (_as_name(words[j][0]) or words[j][0].isupper() and len(words[j][0]) > 2) and text[last : words[j].start()] == " ":
                run.append(words[j])
                last = words[j].end()
                j += 1
        elif _as_name(m[0]) in _GIVEN and k < len(words) and words[k][0] != m[0] and beside(m, words[k]) and (_as_name(words[k][0]) or words[k][0].isupper() and len(words[k][0]) > 3):
            run = [m, words[k]]
            j = k + 1
            if j < len(words) and _as_name(words[k][0]) in _GIVEN and beside(words[k], words[j]) and _as_name(words[j][0]):
                run.append(words[j])
                j += 1
        if not run:
            continue
        k = j
        given = [_GIVEN[n][1] for w in run if (n := _as_name(w[0])) in _GIVEN]
        gender = given[0] if given else "f" if m[0] in _FEMALE_TITLES else "m"
        for i, w in enumerate(run):
            n = _as_name(w[0])
            add(w, _GIVEN[n][1] if n in _GIVEN and (len(run) == 1 or i < len(run) - 1) else gender if i < len(run) - 1 else "s")
    if not roles:
        return []
    for w in words:
        if w.start() not in found and w[0].lower() in roles and (_capital(w[0]) or w[0].isupper()) and w[0] not in _TITLES:
            add(w, roles[w[0].lower()])
    for a, b in zip(words, words[1:]):
        inside = text[: a.start()].rstrip(" ")[-1:]
        if a.start() not in found and b.start() in found and roles[b[0].lower()] == "s" and beside(a, b) and _capital(a[0]) and a[0] not in _TITLES and (inside.isalnum() or inside in ",;"):
            add(a, _GIVEN[a[0]][1] if a[0] in _GIVEN else "m")
    return list(found.values())


def _phone(mention: str) -> str:
    """Country code and number; ten digits without a code are of the North American plan."""
    digits = _only_digits(mention)
    return f"+{digits}" if mention[0] == "+" else f"+1{digits}" if len(digits) == 10 else digits


def detect(text: str) -> list[Mention]:
    """Mentions in order, without overlaps; the earlier kind in the list below wins."""
    found: list[Mention] = []
    digit = any(c in text for c in "0123456789")
    lower = text.lower() if ":" in text or "=" in text else ""
    if "AKIA" in text or "ASIA" in text or "ghp_" in text:
        found += [Mention(m.start(), m.end(), "key", m[0]) for m in _KEY.finditer(text)]
    if lower and any(w in lower for w in ("password", "passwd", "pwd", "token", "secret", "key")):
        for m in _SECRET.finditer(text):
            g = m.lastindex
            found.append(Mention(m.start(g), m.end(g), "secret", m[g]))
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if left and right:
            start = left.start() + len(left[0]) - len(left[0].lstrip(".%+-"))
            end = at + 1 + len(right[0].rstrip("-"))
            if start < at:
                found.append(Mention(start, end, "email", text[start:end].lower()))
        at = text.find("@", at + 1)
    if digit:
        for m in _IBAN.finditer(text):
            canon = m[0].replace(" ", "")
            if 15 <= len(canon) <= 34 and mod97(canon) == 1:
                found.append(Mention(m.start(), m.end(), "iban", canon))
        found += [Mention(m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            for raw in dict.fromkeys((m[0], m[0][:19])):  # the digits after four groups of four may be another number's
                canon = _only_digits(raw)
                if len(canon) >= 13 and luhn(canon) and set(canon) != {"0"}:
                    found.append(Mention(m.start(), m.start() + len(raw), "card", canon))
                    break
        found += [Mention(m.start(), m.end(), "ssn", _only_digits(m[0])) for m in _SSN.finditer(text)]
        rest = list(text)  # what other kinds hold isn't part of a phone number
        for m in found:
            rest[m.start : m.end] = "\0" * (m.end - m.start)
        for m in _PHONE.finditer("".join(rest)):
            canon = _only_digits(m[0])
            if 8 <= len(canon) <= 15:
                found.append(Mention(m.start(), m.end(), "phone", _phone(m[0])))
    found += _names(text)
    rank = {id(m): i for i, m in enumerate(found)}
    out, taken = [], []
    for m in sorted(found, key=lambda m: rank[id(m)]):
        if all(m.end <= a or m.start >= b for a, b in taken):
            taken.append((m.start, m.end))
            out.append(m)
    return sorted(out)
