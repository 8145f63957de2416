"""Spans in texts: base patterns of personal data and secrets, and their digests."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

#: (start, end, kind); offsets count code points, the end is exclusive.
Span = tuple[int, int, str]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")


def emails(text: str) -> list[Span]:
    """Leftmost matches of `[local]+@label(.label)+`; found from each @, so long runs of letters cost nothing."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        tail = _DOMAIN.match(text, at)
        if tail:
            start = at
            while start > free and text[start - 1] in _LOCAL_SET:
                start -= 1
            if start < at:
                found.append((start, tail.end(), "email"))
                free = tail.end()
        at = text.find("@", max(at + 1, free))
    return found


_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def ips(text: str) -> list[Span]:
    ok = lambda p: len(p := p.lstrip("0")) <= 3 and int(p or 0) <= 255
    return [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(ok, m.group().split(".")))]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    return found


def phones(text: str) -> list[Span]:
    return [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def assigns(text: str) -> list[Span]:
    return [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8]


def accesses(text: str) -> list[Span]:
    return [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]


def hexes(text: str) -> list[Span]:
    return [(*m.span(), "hex") for m in _HEX.finditer(text)]


PERSONAL = {"email": emails, "ip": ips, "card": cards, "phone": phones}
SECRETS = {"assign": assigns, "access": accesses, "hex": hexes}


def joined(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then kind in the order of `kinds`, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(set(spans), key=lambda x: (x[0], order.get(x[2], len(order)), x[2], x[1])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def united(spans: list[Span]) -> list[Span]:
    """Disjoint spans that cover the same text in order; one takes the kind of the longest span in it, the first of equals."""
    out: list[list] = []
    for s, e, kind in sorted(spans):
        if out and s < out[-1][1]:
            last = out[-1]
            last[1] = max(last[1], e)
            if e - s > last[3]:
                last[2:] = kind, e - s
        else:
            out.append([s, e, kind, e - s])
    return [(s, e, kind) for s, e, kind, _ in out]


class Taken:
    """Which places spans take, by bisection."""

    def __init__(self, spans: list[Span]):
        whole = united(spans)
        self.starts, self.ends = [s for s, _, _ in whole], [e for _, e, _ in whole]

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start
