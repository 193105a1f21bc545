"""The part of YAML that front matter uses: maps, lists, flow lists and maps, quoted, plain and block scalars, comments.

Anything else (anchors, tags, several documents, tabs as indentation) is an error that names the line, never a guess.
"""

from __future__ import annotations

import json
import re

KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{}#&*!|>%@`,-][^:#]*?|-[^\s:#][^:#]*?|[^\s"'\[\]{}#&*!|>%@`,-](?:[^:#]|:(?!\s|$)|(?<!\s)#)*?)\s*:(?=\s|$)""")
BLOCK = re.compile(r"([|>])([+-]?)([1-9]?)([+-]?)\s*(?:#.*)?$")
WORDS = {"": None, "null": None, "Null": None, "NULL": None, "~": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


class FrontError(ValueError):
    pass


def _plain(text: str):
    if re.fullmatch(r"[-+]?(?:0|[1-9]\d{0,17})", text):
        return int(text)
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?", text) and not re.fullmatch(r"[-+]?0\d+", text):
        return float(text)
    return WORDS.get(text, text)


def _double(text: str) -> str:
    try:
        return json.loads(re.sub(r"\\x([0-9a-fA-F]{2})", r"\\u00\1", text).replace("\t", "\\t"))
    except json.JSONDecodeError as e:
        raise FrontError(f"quoted text {text}") from e


class _Flow:
    """A value on one line, and what stands behind it."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t":
            self.at += 1

    def done(self) -> None:
        self.skip()
        rest = self.text[self.at :]
        if rest and not (rest.startswith("#") and (self.at == 0 or self.text[self.at - 1] in " \t")):
            raise FrontError(f"{rest!r} after a value")

    def value(self, ends: str = ""):
        self.skip()
        c = self.text[self.at : self.at + 1]
        if c == '"' or c == "'":
            m = re.compile(r'"(?:[^"\\]|\\.)*"' if c == '"' else r"'(?:[^']|'')*'").match(self.text, self.at)
            if not m:
                raise FrontError("a quote that does not end")
            self.at = m.end()
            return _double(m[0]) if c == '"' else m[0][1:-1].replace("''", "'")
        if c == "[":
            return self.many("]", lambda: self.value(",]"))
        if c == "{":
            return dict(self.many("}", self.pair))
        if c and c in "&*!%@`|>":
            raise FrontError(f"{c} is not read here")
        stop = re.compile(r"\s#|" + (f"[{re.escape(ends)}]|:(?=\\s)" if ends else r"$(?!.)")).search(self.text, self.at)
        end = stop.start() if stop else len(self.text)
        if self.text.startswith("#", self.at):
            end = self.at
        word, self.at = self.text[self.at : end].strip(), end
        if not ends and re.search(r":(\s|$)", word):
            raise FrontError(f"{word!r} is a map inside a value")
        return _plain(word)

    def pair(self):
        key = self.value(",}:")
        self.skip()
        if self.text[self.at : self.at + 1] != ":":
            return str(key), None
        self.at += 1
        return str(key), self.value(",}")

    def many(self, end: str, one) -> list:
        self.at += 1
        out = []
        while True:
            self.skip()
            c = self.text[self.at : self.at + 1]
            if c == end:
                self.at += 1
                return out
            if not c:
                raise FrontError(f"no {end}")
            out.append(one())
            self.skip()
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1


class _Reader:
    def __init__(self, text: str):
        self.lines, self.at = text.replace("\r\n", "\n").split("\n"), 0

    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line that is not blank and no comment."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            text = line.lstrip(" ")
            if text.strip() and not text.startswith("#"):
                if text.startswith("\t"):
                    raise FrontError(f"line {self.at + 1}: a tab")
                return len(line) - len(text), text.rstrip()
            self.at += 1
        return None

    def block(self, indent: int):
        head = self.peek()
        return self.items(indent) if head and re.match(r"-(\s|$)", head[1]) else self.pairs(indent)

    def items(self, indent: int) -> list:
        out = []
        while (head := self.peek()) and head[0] == indent and re.match(r"-(\s|$)", head[1]):
            rest = head[1][1:]
            inner = indent + 1 + len(rest) - len(rest.lstrip())
            if not rest.strip() or rest.strip().startswith("#"):
                self.at += 1
                out.append(self.under(indent))
            elif KEY.match(rest.strip()) or re.match(r"-(\s|$)", rest.strip()):
                self.lines[self.at] = " " * inner + rest.strip()
                out.append(self.block(inner))
            else:
                self.at += 1
                out.append(self.scalar(rest.strip(), indent))
        return out

    def under(self, indent: int, same: bool = False):
        """What stands below a key or a dash: nothing, or what is indented more; a list of a key may stand at its own indentation."""
        head = self.peek()
        if head and (head[0] > indent or (same and head[0] == indent and re.match(r"-(\s|$)", head[1]))):
            if KEY.match(head[1]) or re.match(r"-(\s|$)", head[1]):
                return self.block(head[0])
            self.at += 1
            return self.scalar(head[1], indent)
        return None

    def pairs(self, indent: int) -> dict:
        out: dict = {}
        while (head := self.peek()) and head[0] == indent:
            m = KEY.match(head[1])
            if not m:
                raise FrontError(f"line {self.at + 1}: no key in {head[1]!r}")
            key = m[1] if m[1][0] not in "\"'" else _Flow(m[1]).value()
            if key in out:
                raise FrontError(f"line {self.at + 1}: {key} is there twice")
            rest = head[1][m.end() :].strip()
            self.at += 1
            out[key] = self.under(indent, True) if not rest or rest.startswith("#") else self.scalar(rest, indent)
        if head and head[0] > indent:
            raise FrontError(f"line {self.at + 1}: indented more than what it belongs to")
        return out

    def scalar(self, text: str, indent: int):
        if m := BLOCK.match(text):
            return self.note(m[1], m[2] or m[4], int(m[3]) if m[3] else 0, indent)
        # a plain or quoted value may go on below, indented more
        first = text
        while not first.startswith(("[", "{", '"', "'")) and not re.search(r"\s#", text) and self.at < len(self.lines):
            line = self.lines[self.at]
            if not line.strip() or len(line) - len(line.lstrip(" ")) <= indent or line.lstrip().startswith("#"):
                break
            text += " " + line.strip()
            self.at += 1
        if first.startswith(("[", "{", '"', "'")):
            while not self.whole(text) and self.at < len(self.lines):
                text += " " + self.lines[self.at].strip()
                self.at += 1
        flow = _Flow(text)
        try:
            value = flow.value()
            flow.done()
        except FrontError as e:
            raise FrontError(f"line {self.at}: {e}") from e
        return value

    @staticmethod
    def whole(text: str) -> bool:
        try:
            _Flow(text).value()
            return True
        except FrontError:
            return False

    def note(self, kind: str, chomp: str, depth: int, indent: int) -> str:
        """Block text: its lines as they are, less their common indentation; > folds single line ends into spaces."""
        rows = []
        width = indent + depth if depth else 0
        while self.at < len(self.lines):
            line = self.lines[self.at]
            own = len(line) - len(line.lstrip(" "))
            if line.strip():
                width = width or own
                if own < width or own <= indent:
                    break
            rows.append(line[width:] if line.strip() else "")
            self.at += 1
        blank = 0
        while rows and not rows[-1]:
            rows.pop()
            blank += 1
        if kind == "|":
            text = "\n".join(rows)
        else:
            text, n = "", 0
            for i, row in enumerate(rows):
                deep = row.startswith((" ", "\t"))
                if not row:
                    n += 1
                    continue
                if text or n:
                    before = i > 0 and rows[i - 1 - n].startswith((" ", "\t")) if i - 1 - n >= 0 else False
                    text += "\n" * (n + 1 if deep or before else n) if n or deep or before else " "
                text, n = text + row, 0
        if chomp == "-" or not rows:
            return text
        return text + "\n" * (1 + (blank if chomp == "+" else 0))


def parse(text: str) -> dict:
    """The map that a front matter is; FrontError where it is none that can be read."""
    r = _Reader(text)
    head = r.peek()
    if head is None:
        return {}
    got = r.block(head[0])
    if r.peek() is not None:
        raise FrontError(f"line {r.at + 1}: indented less than what came before")
    if not isinstance(got, dict):
        raise FrontError("no map")
    return got
