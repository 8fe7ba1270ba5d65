"""Labelled spans of personal data: texts made from a seed, of which every span is known.

Each kind comes in forms that the fixed patterns know and in forms that they
cannot express (spelt-out addresses, colon and bracketed IPs, cards in other
groups, national telephone numbers), among words of several scripts and among
numbers and marks that are no personal data.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
_SYLLABLES = ("the and er in tion st re on at ing ou ly ed sh wh ne ha ea or es ble ment eau ier ai que pa ch tr vi le rou ein ung keit sch ver ä ö ü ß gen lich "
              "zu auf ción ado mente os ar ñ ó í ez ra ta mi bo ti na ко на ре ст во ми 水 木 日 本").split()
_TOPS = "com org net io de fr es edu gov co.uk info dev".split()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


class Maker:
    """Texts and their spans from a random generator."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def num(self, a: int, b: int) -> int:
        return int(self.rng.integers(a, b))

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n).tolist()))

    def letters(self, a: int, b: int) -> str:
        return "".join(chr(97 + x) for x in self.rng.integers(0, 26, self.num(a, b)).tolist())

    def hexes(self, n: int) -> str:
        return "".join("0123456789abcdef"[x] for x in self.rng.integers(0, 16, n).tolist())

    def word(self) -> str:
        w = "".join(self.pick(_SYLLABLES) for _ in range(self.num(1, 5)))
        return self.pick([w, w, w, w.capitalize(), w.upper()])

    # ------------------------------------------------------------ personal data

    def email(self) -> str:
        user = self.pick([self.letters(1, 9), "".join(self.pick(_SYLLABLES[:30]) for _ in range(self.num(1, 4)))])
        user += self.pick(["", "", "." + self.letters(1, 8), self.digits(2), "." + self.digits(2), "_" + self.letters(2, 4), "+" + self.letters(2, 5), "-" + self.letters(2, 6)])
        host = self.pick([self.letters(2, 10), f"mail{self.digits(1)}.example", f"{self.letters(2, 5)}-{self.letters(2, 5)}", f"{self.letters(2, 6)}.{self.letters(2, 7)}"])
        at = self.pick(["@"] * 5 + ["[at]", " [at] ", "(at)", " (at) ", "{at}", " @ ", " AT "])
        plain = at == "@" or self.num(0, 2)
        dot = "." if plain else self.pick([" [dot] ", "(dot)", "[dot]", " DOT "])
        top = self.pick(_TOPS)
        s = f"{user}{at}{host if plain else host.replace('.', dot)}{dot}{top}"
        return s.upper() if self.num(0, 12) == 0 else s

    def ip(self) -> str:
        q = [str(self.num(0, 256)) for _ in range(4)]
        groups = [self.hexes(self.num(1, 5)) for _ in range(8)]
        short = self.num(1, 5)
        return self.pick([".".join(q)] * 5 + ["[.]".join(q), ":".join(groups), ":".join(groups[:short]) + "::" + ":".join(groups[: self.num(1, 3)])])

    def card(self) -> str:
        n = self.pick([16, 16, 16, 16, 15, 19])
        d = self.digits(n - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = self.pick(["", "", " ", "-", ".", "/", " ", "_"])
        cuts = [0, 4, 10, 15] if n == 15 else [*range(0, n, 4), n]
        return sep.join(d[a:b] for a, b in zip(cuts, cuts[1:]))

    def phone(self) -> str:
        d = self.digits
        return self.pick([
            lambda: f"+{self.num(1, 10)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)} {d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}",
            lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{self.num(20, 99)} {d(2)} {d(4)} {d(4)}", lambda: f"+{self.num(20, 99)} {d(3)} {d(3)} {d(3)}", lambda: f"00{self.num(20, 99)} {d(2)} {d(7)}",
            lambda: f"+{self.num(20, 99)}{d(9)}", lambda: f"0{d(2)}/{d(7)}", lambda: f"0{d(3)} {d(6)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+33.{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}",
        ])()

    # ------------------------------------------------------------ what is none

    def other(self) -> str:
        d, n = self.digits, self.num
        return self.pick([
            lambda: f"{n(0, 100)}.{n(0, 1000)}", lambda: f"{n(0, 10)}.{n(0, 20)}.{n(0, 20)}", lambda: f"v{n(0, 10)}.{n(0, 20)}.{n(0, 9)}-rc{n(1, 4)}", lambda: f"version {n(1, 9)}.0", lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}",
            lambda: f"{n(1, 29):02}.{n(1, 13):02}.{n(1900, 2100)}", lambda: f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2100)}", lambda: f"{n(0, 24):02}:{n(0, 60):02}", lambda: f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", lambda: f"{n(1900, 2100)}", lambda: d(n(1, 9)),
            lambda: f"{n(1900, 2000)}-{n(2000, 2100)}", lambda: f"${n(1, 999)}.{d(2)}", lambda: f"{n(1, 999)},{d(3)},{d(3)}", lambda: f"{n(1, 99)}%", lambda: f"{n(1, 999)} {d(3)} {d(3)}", lambda: f"978-{n(0, 9)}-{d(2)}-{d(6)}-{n(0, 10)}", lambda: f"#{d(n(2, 7))}",
            lambda: f'token = "{self.hexes(40)}"', lambda: self.hexes(32), lambda: self.hexes(64), lambda: f"{self.hexes(8)}-{self.hexes(4)}-4{self.hexes(3)}-a{self.hexes(3)}-{self.hexes(12)}", lambda: f"sk_{self.letters(10, 20)}{d(4)}",
            lambda: f"{self.letters(2, 6).upper()}{d(n(2, 6))}", lambda: f"{self.letters(2, 4).upper()}-{d(n(2, 6))}", lambda: f"@{self.letters(3, 12)}", lambda: f"{self.letters(3, 8)}@{n(1, 20)}.{n(0, 20)}.{n(0, 9)}", lambda: f"x = {n(0, 100)} @ y",
            lambda: f"https://{self.letters(3, 9)}.{self.pick(_TOPS)}/{self.letters(2, 8)}?id={d(n(1, 7))}", lambda: f"www.{self.letters(3, 9)}.{self.pick(_TOPS)}", lambda: f"{self.letters(3, 8)}.{self.letters(2, 4)}", lambda: f"{n(0, 180)}.{d(5)}, -{n(0, 90)}.{d(5)}",
            lambda: f"{n(0, 9)}:{n(0, 9)}", lambda: f"{n(1, 20)}-{n(1, 20)}", lambda: f"CC BY-NC {n(1, 5)}.0.", lambda: f"{d(2)} + {d(2)} = {d(3)}", lambda: f"{self.letters(1, 4)}[{n(0, 99)}]", lambda: f"std::{self.letters(3, 7)}", lambda: f"{n(1, 9)}e-{n(1, 20)}", lambda: f"<{self.letters(1, 5)} id=\"{d(3)}\">",
            lambda: f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"look at dot {self.letters(2, 6)}", lambda: f"meet at {n(1, 12)} dot", lambda: f"({self.letters(2, 8)})", lambda: f"[{self.letters(2, 8)}]",
        ])()

    def text(self, size: int) -> tuple[str, list[tuple[int, int, int]]]:
        """At least ``size`` characters and the spans ``(kind, start, end)`` in them."""
        text, spans = "", []
        share = self.pick([0.0, 0.0, 0.0, 0.02, 0.02, 0.1, 0.25])
        again, w = self.pick([0.0] * 8 + [0.9, 0.5]), self.word()  # words may repeat
        mark = self.pick([""] * 6 + ["".join(self.pick("%*#!&$~^=+<>/|@")) * self.num(1, 5) for _ in range(3)])
        while len(text) < size:
            roll = self.rng.random()
            if roll < share:
                kind = self.num(0, len(KINDS))
                s = (self.email, self.ip, self.card, self.phone)[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                w = w if self.rng.random() < again else self.word()
                s = self.other() if roll < 2 * share else w
            text += s + (mark if mark and self.num(0, 2) else "") + self.pick([" "] * 12 + [", ", ", ", ". ", ". ", ".\n", "\n", "; ", " - ", ") ", '" ', " | ", "! "])
        return text, spans
