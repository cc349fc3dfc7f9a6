"""PDF values: a lexer over Latin-1 text, and values as tagged JSON.

Values are None, bool, int or float, Name (a str), Text and Hex strings, list,
dict and Ref. Nothing here raises on damaged input, and nesting is bounded.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

SPACES = "\x00\t\n\x0c\r "
DEEPEST = 400
_SKIP = re.compile(r"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_ATOM = re.compile(r"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)")
_RADIX = re.compile(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)")
_HASH = re.compile(r"#([0-9a-fA-F]{2})")
_IN_STRING = re.compile(r"[^\\()]+")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


class Name(str):
    """A name, or an atom that is nothing else."""

    __slots__ = ()


@dataclass(frozen=True, slots=True)
class Text:
    """A literal string; chars are bytes."""

    value: str

    def bytes(self) -> bytes:
        return self.value.encode("latin-1", "replace")


@dataclass(frozen=True, slots=True)
class Hex:
    """A hex string as written, without white space."""

    value: str

    def bytes(self) -> bytes:
        return hex_bytes(self.value)


@dataclass(frozen=True, slots=True)
class Ref:
    id: float
    generation: float


def hex_bytes(digits: str) -> bytes:
    """Odd length gets a zero digit; a pair that doesn't start with a digit is 0, one that starts with one counts that."""
    digits += "0" * (len(digits) % 2)
    try:
        return bytes.fromhex(digits) if not re.search(r"\s", digits) else bytes(map(_pair, re.findall("..", digits, re.S)))
    except ValueError:
        return bytes(map(_pair, re.findall("..", digits, re.S)))


def _pair(two: str) -> int:
    m = re.match(r"[0-9a-fA-F]+", two.strip())
    return int(m[0], 16) if m else 0


def number(atom: str) -> float | int | None:
    """The number that an atom stands for, if any; the empty atom is 0."""
    s = atom.strip()
    if not s:
        return 0
    if _NUMBER.fullmatch(s):
        n = float(s)
        return None if math.isinf(n) else int(n) if n == int(n) else n
    return int(s, 0) if _RADIX.fullmatch(s) else None


def as_number(value) -> float:
    """A value where a number is wanted: numbers and booleans count, text that reads as one too, the rest is NaN."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int | float):
        return value
    if value is None:
        return 0
    if isinstance(value, str):
        n = number(value)
        return math.nan if n is None else n
    if isinstance(value, list) and len(value) < 2:
        return as_number(value[0]) if value else 0
    return math.nan


def truthy_number(value, default: float = 0) -> float:
    """A value's number, or the default for 0 and for what is no number."""
    n = math.nan if value is MISSING else as_number(value)
    return default if n == 0 or n != n else n


class _Missing:
    def __bool__(self) -> bool:
        return False

    def __repr__(self) -> str:
        return "MISSING"


#: What is not there, unlike null.
MISSING = _Missing()


class Lexer:
    def __init__(self, source: str, at: int = 0):
        self.source, self.at, self.depth = source, at, 0

    def skip(self) -> None:
        self.at = _SKIP.match(self.source, self.at).end()

    def atom(self) -> str:
        """A run of ordinary characters; at a delimiter, that one character."""
        self.skip()
        m = _ATOM.match(self.source, self.at)
        end = m.end() if m else min(self.at + 1, len(self.source))
        found, self.at = self.source[self.at : end], end
        return found

    def value(self):
        self.skip()
        two = self.source[self.at : self.at + 2]
        kind = two[:1]
        if two == "<<" or kind == "[":
            if self.depth >= DEEPEST:
                self.at += len(two) if two == "<<" else 1
                return None
            self.depth += 1
            made = self._dict() if two == "<<" else self._list()
            self.depth -= 1
            return made
        if kind == "/":
            return self.name()
        if kind == "(":
            return self._text()
        if kind == "<":
            end = self.source.find(">", self.at)
            body = self.source[self.at + 1 : end if end >= 0 else None]
            self.at = end + 1 if end >= 0 else len(self.source)
            return Hex(re.sub(r"\s+", "", body))
        return self._atom_or_ref()

    def name(self) -> Name:
        """Skips one character, whatever it is, then takes a run of ordinary ones."""
        start = min(self.at + 1, len(self.source))
        m = _ATOM.match(self.source, start)
        self.at = m.end() if m else start
        raw = self.source[start : self.at]
        return Name(_HASH.sub(lambda h: chr(int(h[1], 16)), raw) if "#" in raw else raw)

    def _dict(self) -> dict:
        made = {}
        self.at += 2
        while self.at < len(self.source):
            self.skip()
            if self.source.startswith(">>", self.at):
                self.at += 2
                break
            key = self.name()
            made[str(key)] = self.value()
        return made

    def _list(self) -> list:
        made = []
        self.at += 1
        while self.at < len(self.source):
            self.skip()
            if self.source.startswith("]", self.at):
                self.at += 1
                break
            made.append(self.value())
        return made

    def _text(self) -> Text:
        out, level, source = [], 1, self.source
        self.at += 1
        while self.at < len(source):
            if m := _IN_STRING.match(source, self.at):
                out.append(m[0])
                self.at = m.end()
                continue
            c = source[self.at]
            self.at += 1
            if c == "\\":
                out.append(self._escape())
                continue
            level += 1 if c == "(" else -1
            if not level:
                break
            out.append(c)
        return Text("".join(out))

    def _escape(self) -> str:
        if m := re.compile(r"[0-7]{1,3}").match(self.source, self.at):
            self.at = m.end()
            return chr(int(m[0], 8) & 255)
        c = self.source[self.at : self.at + 1]
        self.at += len(c)
        if c == "\r" and self.source[self.at : self.at + 1] == "\n":
            self.at += 1
        return "" if c in ("\r", "\n") else _ESCAPES.get(c, c)

    def _atom_or_ref(self):
        first = self.atom()
        n = number(first)
        if n is None:
            return {"true": True, "false": False, "null": None}.get(first, Name(first))
        back = self.at
        generation = number(self.atom())
        self.skip()
        if generation is not None and self.source.startswith("R", self.at):
            self.at += 1
            return Ref(n, generation)
        self.at = back
        return n


def parse(source: str, at: int = 0):
    return Lexer(source, at).value()


def tokens(source: str, most: int):
    """(is operator, value) of a content stream. true, false and null are operators, as any other word is."""
    lex, made = Lexer(source), []
    while lex.at < len(source):
        if len(made) >= most:
            from quire.functions.limits import PdfError

            raise PdfError(f"PDF limit exceeded: content tokens > {most}")
        lex.skip()
        if lex.at >= len(source):
            break
        if source[lex.at] in "/[(<":
            made.append((False, lex.value()))
            continue
        word = lex.atom()
        n = number(word)
        made.append((True, word) if n is None else (False, n))
    return made


def tagged(value):
    """A value as JSON data: names, strings and references keep their kind."""
    if isinstance(value, Name):
        return {"n": str(value)}
    if isinstance(value, Text):
        return {"s": value.value}
    if isinstance(value, Hex):
        return {"h": value.value}
    if isinstance(value, Ref):
        return {"r": value.id, "g": value.generation}
    if isinstance(value, list):
        return [tagged(v) for v in value]
    if isinstance(value, dict):
        return {"d": {k: tagged(v) for k, v in value.items()}}
    return value


def to_json(value) -> str:
    return json.dumps(tagged(value), ensure_ascii=False, separators=(",", ":"))


def number_text(n) -> str:
    """A number as people write it: 3 rather than 3.0."""
    return str(int(n)) if isinstance(n, float) and n.is_integer() and abs(n) < 1e21 else repr(n) if isinstance(n, float) else str(n)
