"""Patterns of a linear-time regex engine (RE2 syntax) in Java's terms, with the same matches."""

from __future__ import annotations

import re

#: POSIX class names and what they hold in ASCII. Fixed values.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": r"\x21-\x7E",
    "lower": "a-z", "print": r"\x20-\x7E", "punct": r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Escapes that stand for one character, and for classes. Fixed values.
SINGLE = {"a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B"}
CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r\x20"}
MOST_REPEATS = 1000


class _Refused(ValueError):
    pass


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        # whether ^ and $ mean lines, by open group; groups' names
        self.lines, self.names = [False], set()

    def take(self, pattern: str) -> re.Match | None:
        found = re.compile(pattern).match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def literal(self, c: str) -> str:
        return c if c.isalnum() or ord(c) > 126 or c in "_ " else rf"\x{{{ord(c):x}}}"

    def escape(self, inside: bool) -> str:
        """What follows a backslash."""
        if found := self.take(r"x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})"):
            point = int(found[1] or found[2], 16)
            if point > 0x10FFFF:
                raise _Refused
            return rf"\x{{{point:x}}}"
        if found := self.take(r"0[0-7]{0,2}|[1-7][0-7]{1,2}"):
            return rf"\x{{{int(found[0], 8):x}}}"
        if found := self.take(r"([pP])(?:\{(\^?)(\w+)\}|([A-Z]))"):
            name = found[3] or found[4]
            letter = found[1] if not found[2] else "pP"[found[1] == "p"]
            if name == "Any":
                return r"\x{0}-\x{10FFFF}" if inside and letter == "p" else r"[\x{0}-\x{10FFFF}]" if letter == "p" else r"[^\x{0}-\x{10FFFF}]"
            return rf"\{letter}{{{name if len(name) < 3 else 'Is' + name}}}"
        c = self.text[self.at : self.at + 1]
        self.at += 1
        if c in SINGLE:
            return SINGLE[c]
        if c.lower() in CLASSES and c:
            own = CLASSES[c.lower()]
            return own if inside and c.islower() else f"[{'^' * c.isupper()}{own}]"
        if not inside and c in ("b", "B"):
            # word borders of ASCII words
            here = r"(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])"
            return f"(?:{here})" if c == "b" else f"(?!{here})"
        if not inside and c in ("A", "z"):
            return rf"\{c}"
        if not c or c.isalnum() or ord(c) > 126:
            raise _Refused
        return self.literal(c)

    def brackets(self) -> str:
        """A class, after its opening bracket."""
        out = "[" + ("^" if self.take(r"\^") else "")
        first = True
        while True:
            if found := self.take(r"\[:(\^?)(\w+):\]"):
                if found[2] not in POSIX:
                    raise _Refused
                out += f"[{found[1]}{POSIX[found[2]]}]" if found[1] else POSIX[found[2]]
            elif not first and self.take(r"\]"):
                return out + "]"
            elif self.take(r"\\"):
                out += self.escape(True)
            elif found := self.take(r"(?s)."):
                # a hyphen between two characters makes a range; first or last it is a hyphen
                dash = found[0] == "-" and not first and self.text[self.at : self.at + 1] not in ("]", "")
                out += "-" if dash else self.literal(found[0])
            else:
                raise _Refused
            first = False

    def group(self) -> None:
        lines = self.lines[-1]
        if found := self.take(r"\?P?<(\w+)>"):
            if found[1] in self.names:
                raise _Refused
            self.names.add(found[1])
            self.out.append("(")
        elif found := self.take(r"\?([imsU]*)(?:-([imsU]+))?([:)])"):
            on, off = (x or "" for x in found.groups()[:2])
            if found[3] == ")" and not on + off:
                raise _Refused
            lines = (lines or "m" in on) and "m" not in off
            # which of equal matches is taken doesn't matter here
            on, off = (x.replace("U", "") for x in (on, off))
            flags = on + ("-" + off if off else "")
            if found[3] == ")":
                self.lines[-1] = lines
                self.out.append(f"(?{flags})" if flags else "(?:)")
                return
            self.out.append(f"(?{flags}:")
        elif self.take(r"\?"):
            raise _Refused
        else:
            self.out.append("(")
        self.lines.append(lines)

    def java(self) -> str:
        repeatable = False
        while self.at < len(self.text):
            if found := self.take(r"[*+?]\??|\{(\d+)(?:,(\d*))?\}\??"):
                if not repeatable or max(int(x or 0) for x in (found[1], found[2])) > MOST_REPEATS or found[2] and int(found[1]) > int(found[2]):
                    raise _Refused
                self.out.append(found[0])
                repeatable = False
                continue
            repeatable = True
            if self.take(r"\("):
                self.group()
                repeatable = self.out[-1].endswith(")")
            elif self.take(r"\)"):
                if len(self.lines) == 1:
                    raise _Refused
                self.lines.pop()
                self.out.append(")")
            elif self.take(r"\["):
                self.out.append(self.brackets())
            elif found := self.take(r"(?s)\\Q(.*?)(?:\\E|\Z)"):
                self.out += map(self.literal, found[1])
                repeatable = bool(found[1])
            elif self.take(r"\\"):
                self.out.append(self.escape(False))
            elif self.take(r"\$"):
                self.out.append("$" if self.lines[-1] else r"\z")
            elif found := self.take(r"[.^|]"):
                self.out.append(found[0])
                repeatable = found[0] != "|"
            else:
                self.out.append(self.literal(self.text[self.at]))
                self.at += 1
        if len(self.lines) > 1:
            raise _Refused
        # only the line feed ends a line
        return "(?d)" + "".join(self.out)


def to_java(pattern) -> str | None:
    """The same pattern for Java's engine, or None if RE2 would refuse it."""
    if not isinstance(pattern, str):
        return None
    try:
        return _Reader(pattern).java()
    except _Refused:
        return None


def accepted(spark, pattern) -> str | None:
    """``to_java``, if Java's engine takes it too (it knows which Unicode classes there are)."""
    java = to_java(pattern)
    if java is not None and spark is not None and hasattr(spark, "_jvm"):
        from pyspark.errors import IllegalArgumentException

        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except IllegalArgumentException:
            return None
    return java
