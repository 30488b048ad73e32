"""Source code as text, blocks and statements: one scanner for brace languages (Java, Go, JavaScript and TypeScript).

Literals and comments are blanked to spaces first, at equal length, so offsets and lines stay and no brace in a string counts.
A block knows its header, the text since the last statement or block ended; languages differ in how they read headers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_LITERAL = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|`(?:\\.|[^`\\])*`?', re.S)
_NOT_LINE_END = re.compile(r"[^\n]")
_ANNOTATION = re.compile(r"@[A-Za-z_][\w.]*(?:\s*\((?:[^()]|\([^()]*\))*\))?\s*")
EXIT = re.compile(r"(return|throw|break|continue|panic)\b")


def blank(text: str) -> str:
    return _LITERAL.sub(lambda m: _NOT_LINE_END.sub(" ", m[0]), text)


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a final line end makes no further line."""
    out = text.split("\n")
    if out and not out[-1]:
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


@dataclass
class Block:
    head: int  # where the header starts
    open: int
    close: int
    header: str
    parent: int


class Source:
    """A file: its text, its code with literals blanked, its lines and its blocks."""

    def __init__(self, text: str, lang: str = "java"):
        self.text, self.lang = text, lang
        self.code = blank(text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.lines = lines_of(text)
        self.blocks = self._blocks()

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def line_text(self, n: int) -> str:
        return self.lines[n - 1] if 0 < n <= len(self.lines) else ""

    def code_line(self, n: int) -> str:
        if not 0 < n <= len(self.starts):
            return ""
        return self.code[self.starts[n - 1] : self.starts[n] if n < len(self.starts) else len(self.code)].rstrip("\r\n")

    def _blocks(self) -> list[Block]:
        out: list[Block] = []
        open_: list[int | None] = []  # blocks, or None for a round bracket
        within: dict[int, int] = {}  # of blocks inside round brackets, where the statement around them starts
        head = 0
        for m in re.finditer(r"[{}();]|\n", self.code):
            c, at = m[0], m.start()
            in_round = bool(open_) and open_[-1] is None
            if c == "(":
                open_.append(None)
            elif c == ")":
                if in_round:
                    open_.pop()
            elif c == "{":
                parent = next((x for x in reversed(open_) if x is not None), -1)
                out.append(Block(head, at, len(self.code), self.code[head:at], parent))
                if in_round:
                    within[len(out) - 1] = head
                open_.append(len(out) - 1)
                head = at + 1
            elif c == "}":
                while open_ and open_[-1] is None and any(x is not None for x in open_):
                    open_.pop()
                k = open_.pop() if open_ and open_[-1] is not None else None
                if k is not None:
                    out[k].close = at
                head = within.get(k, at + 1)
            elif (c == ";" and not in_round) or (c == "\n" and self.lang != "java" and not in_round and self._ends(head, at)):
                head = at + 1
        return out

    def _ends(self, head: int, at: int) -> bool:
        """Whether a line end ends a statement, in languages that need no semicolon: not within an open header."""
        said = self.code[head:at].strip()
        return bool(said) and not said.endswith((",", "=", "=>", "&&", "||", "+", ".", "("))

    def close_of(self, open_: int) -> int:
        """The bracket that closes the one at open_, or the end."""
        pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
        o, c = self.code[open_], pairs[self.code[open_]]
        for m in re.finditer(re.escape(o) + "|" + re.escape(c), self.code[open_:]):
            depth += 1 if m[0] == o else -1
            if not depth:
                return open_ + m.start()
        return len(self.code)


@dataclass
class Function:
    name: str
    owner: str
    start: int
    end: int
    sig: str
    annotations: list[str]
    open: int
    close: int


@dataclass
class Type:
    name: str
    kind: str
    abstract: bool
    extends: str
    extends_args: list[str]
    implements: list[str]
    annotations: list[str]
    line: int
    end: int
    package: str
    fields: list[tuple[str, str, int]] = field(default_factory=list)  # of a declared type
    members: list[str] = field(default_factory=list)  # all fields, those of plain values included


_TYPE = re.compile(r"(?:\b(abstract)\s+(?:\w+\s+)*?)?\b(class|interface|enum|record)\s+([A-Za-z_]\w*)")
_METHOD = re.compile(r"([A-Za-z_$][\w$]*)\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?:throws\s+[\w.,\s]+)?$")
_GO_FUNC = re.compile(r"func\s*(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(")
_JS_FUNC = (re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\("), re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^{]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>\s*$"), re.compile(r"^\s*(?:export\s+)?(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^{}]*\)\s*(?::[^{}]+)?$"))
_CONTROL = {"if", "for", "while", "switch", "catch", "else", "do", "try", "finally", "synchronized", "return", "new", "function", "case", "throw"}
_FIELD = re.compile(r"(?:(?:private|protected|public|final|static|transient|volatile)\s+)*([A-Z]\w*)(?:\s*<[^;=]*>)?\s+([a-z_]\w*)\s*(?:=|$)")
_MEMBER = re.compile(r"(?:(?:private|protected|public|final|static|transient|volatile)\s+)*(?:[A-Z][\w.]*|boolean|byte|char|double|float|int|long|short)(?:\s*<[^;=]*>)?(?:\s*\[\s*\])*\s+([A-Za-z_]\w*)\s*(?:=|$)")


def simple_name(s: str) -> str:
    return s.partition("<")[0].strip().rpartition(".")[2].strip()


def generic_args(s: str) -> list[str]:
    inner = s[s.find("<") + 1 : s.rfind(">")] if "<" in s and ">" in s else ""
    return [n for n in map(simple_name, inner.split(",")) if n]


def _annotations(src: Source, head: int, end: int) -> tuple[list[str], int]:
    """The annotations a header starts with, as written, and where the rest starts."""
    at, found = head, []
    while True:
        at += len(src.code[at:end]) - len(src.code[at:end].lstrip())
        m = _ANNOTATION.match(src.code, at, end)
        if not m or src.code.startswith("@interface", at):
            return found, at
        found.append(" ".join(src.text[at : m.end()].split()))
        at = m.end()


def types(src: Source) -> dict[int, Type]:
    """Type declarations by their block."""
    out = {}
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", src.code, re.M)
    for k, b in enumerate(src.blocks):
        notes, at = _annotations(src, b.head, b.open)
        header = src.code[at : b.open]
        m = _TYPE.search(header)
        if not m or "(" in header[: m.start()]:
            continue
        rest = _after_generics(header[m.end() :])
        up = re.search(r"\bextends\s+([\w.]+(?:\s*<[^{]*?>)?)", rest)
        does = re.search(r"\bimplements\s+(.+)$", rest, re.S)
        t = Type(m[3], m[2], m[1] == "abstract" or "abstract" in header[: m.start()].split() or m[2] == "interface", simple_name(up[1]) if up else "", generic_args(up[1]) if up else [],
                 [simple_name(x) for x in re.split(r",(?![^<]*>)", does[1])] if does else [], notes, src.line(at + m.start()), src.line(b.close), package[1] if package else "")
        at = b.open + 1
        kids = [x for x in src.blocks if x.parent == k]
        for piece, start in _between(src, b, kids):
            clean, skip = _strip(piece)
            if f := _MEMBER.match(clean):
                t.members.append(f[1])
            if f := _FIELD.match(clean):
                t.fields.append((f[2], f[1], src.line(start + skip)))
        out[k] = t
    return out


def _after_generics(s: str) -> str:
    """What follows a type's own parameters."""
    depth = 0
    if not s.lstrip().startswith("<"):
        return s
    for i, c in enumerate(s):
        depth += (c == "<") - (c == ">")
        if c == ">" and not depth:
            return s[i + 1 :]
    return s


def _strip(piece: str) -> tuple[str, int]:
    """A declaration without annotations and outer space, and how much was cut in front."""
    at = 0
    while True:
        at += len(piece[at:]) - len(piece[at:].lstrip())
        m = _ANNOTATION.match(piece, at)
        if not m:
            return piece[at:].strip(), at
        at = m.end()


def _between(src: Source, b: Block, kids: list[Block]):
    """The statements of a block that stand between its own blocks: (text, offset)."""
    at = b.open + 1
    for stop in [*((x.open, x.close) for x in kids), (b.close, b.close)]:
        for m in re.finditer(r"[^;]+(;|$)", src.code[at : stop[0]]):
            if m[1]:
                yield m[0].rstrip(";"), at + m.start()
        at = stop[1] + 1


def functions(src: Source, owners: dict[int, Type] | None = None) -> list[Function]:
    """Functions and methods with their spans, in order. owners: types(src), where that is known."""
    out = []
    if owners is None:
        owners = types(src) if src.lang in ("java", "js") else {}
    inside = -1  # the end of the last function: what stands within is part of it
    for b in src.blocks:
        notes, at = _annotations(src, b.head, b.open) if src.lang == "java" else ([], b.head + len(b.header) - len(b.header.lstrip()))
        header = src.code[at : b.open].strip()
        owner = owners[b.parent].name if b.parent in owners else ""
        name = None
        if src.lang == "java":
            m = _METHOD.search(header) if b.parent in owners or not owners else None
            name = m[1] if m and m[1] not in _CONTROL and "=" not in header[: m.start()] and not header.startswith("new ") else None
        elif src.lang == "go":
            m = _GO_FUNC.match(header)
            name = m[1] if m else None
        else:
            for k, rx in enumerate(_JS_FUNC):
                if (m := rx.search(header)) and (k < 2 or b.parent in owners) and m[1] not in _CONTROL:
                    name = m[1]
                    break
        if name is None or at < inside:
            continue
        inside = b.close
        out.append(Function(name, owner, src.line(at), src.line(b.close), " ".join(src.text[at : b.open].split()), notes, b.open, b.close))
    return out


@dataclass
class Node:
    """A statement (kind stmt), or a branch (if), loop (loop), or guarded region (region) with what is in it."""

    kind: str
    start: int
    end: int
    text: str = ""
    cond: str = ""
    body: list[Node] = field(default_factory=list)
    alt: list[Node] | None = None
    has_else: bool = False

    @property
    def exits(self) -> bool:
        return self.kind == "stmt" and bool(EXIT.match(self.text))


class Statements:
    """Statements of a function's body, by descent over the blanked code; offsets become lines at the end."""

    def __init__(self, src: Source):
        self.src, self.code = src, src.code

    def body(self, open_: int, close: int) -> list[Node]:
        return self._many(open_ + 1, close)

    def _many(self, at: int, stop: int) -> list[Node]:
        out = []
        while (at := self._skip(at, stop)) < stop:
            node, at = self._one(at, stop)
            if node:
                out.append(node)
        return out

    def _skip(self, at: int, stop: int) -> int:
        while at < stop and (self.code[at].isspace() or self.code[at] in ";}"):
            at += 1
        return at

    def _word(self, at: int) -> str:
        m = re.compile(r"[A-Za-z_$]\w*").match(self.code, at)
        return m[0] if m else ""

    def _header(self, at: int, stop: int) -> tuple[str, int]:
        """The condition behind a keyword and where the body starts: in brackets, or in Go as far as the brace."""
        at = self._skip(at, stop)
        if at < stop and self.code[at] == "(" and self.src.lang != "go":
            close = min(self.src.close_of(at), stop)
            return " ".join(self.src.text[at + 1 : close].split()), close + 1
        brace = self.code.find("{", at, stop)
        brace = stop if brace < 0 else brace
        return " ".join(self.src.text[at:brace].split()).rpartition("; ")[2], brace

    def _part(self, at: int, stop: int) -> tuple[list[Node], int]:
        """A block in braces, or a single statement."""
        at = self._skip(at, stop)
        if at < stop and self.code[at] == "{":
            close = min(self.src.close_of(at), stop)
            return self._many(at + 1, close), close + 1
        node, at = self._one(at, stop)
        return [node] if node else [], at

    def _one(self, at: int, stop: int) -> tuple[Node | None, int]:
        line, word = self.src.line, self._word(at)
        if self.code[at] == "{":
            close = min(self.src.close_of(at), stop)
            return Node("region", line(at), line(close), body=self._many(at + 1, close)), close + 1
        if word == "if":
            cond, body_at = self._header(at + 2, stop)
            body, end = self._part(body_at, stop)
            node = Node("if", line(at), line(max(at, end - 1)), cond=cond, body=body)
            nxt = self._skip_space(end, stop)
            if self._word(nxt) == "else":
                node.has_else = True
                node.alt, end = self._part(nxt + 4, stop)
                node.end = line(max(at, end - 1))
            return node, end
        if word in ("for", "while", "switch", "select"):
            cond, body_at = self._header(at + len(word), stop)
            body, end = self._part(body_at, stop)
            return Node("loop" if word in ("for", "while") else "region", line(at), line(max(at, end - 1)), text=word, cond=cond, body=body), end
        if word in ("try", "do", "finally", "synchronized", "catch"):
            _, body_at = self._header(at + len(word), stop) if word in ("synchronized", "catch") or self._after(at, word) == "(" else ("", at + len(word))
            body, end = self._part(body_at, stop)
            if word == "do":
                semi = self.code.find(";", end, stop)
                end = stop if semi < 0 else semi + 1
            return Node("loop" if word == "do" else "region", line(at), line(max(at, end - 1)), text=word, body=body), end
        if word in ("case", "default"):
            colon = re.compile(r":(?!:)|->").search(self.code, at, stop)
            return None, colon.end() if colon else stop
        return self._plain(at, stop)

    def _after(self, at: int, word: str) -> str:
        at += len(word)
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return self.code[at : at + 1]

    def _skip_space(self, at: int, stop: int) -> int:
        while at < stop and self.code[at].isspace():
            at += 1
        return at

    def _plain(self, at: int, stop: int) -> tuple[Node, int]:
        i = at
        while i < stop:
            c = self.code[i]
            if c in "({[":
                i = min(self.src.close_of(i), stop)
            elif c == ";" or (c == "\n" and self.src.lang != "java" and self.src._ends(at, i)):
                break
            elif c == "}":
                break
            i += 1
        i = min(i, stop)
        text = self.src.text[at:i].strip()
        return Node("stmt", self.src.line(at), self.src.line(max(at, i - 1)), text=text), i + 1
