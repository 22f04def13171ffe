"""Comments, strings and patterns of source texts as spaces, read by small state machines.

A state is what is open: templates with code inside, nested comments, delimiters inside literals of words, here-documents.
Every text has a result: what is never closed ends with its line (strings) or with the text (the rest).
"""

from __future__ import annotations

import re
from collections.abc import Callable

DEEPEST = 40

_QUOTED = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}", re.S) for q in "\"'`"}
_SHOWN = re.compile(r"[^\n]")
_SIGNS = re.compile(r"//|/\*|[/\"'`{}]")
_TEMPLATE = re.compile(r"(?:\\.|[^\\`$]|\$(?!\{))*", re.S)
_PATTERN = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_WORD = re.compile(r"[\w$]+\Z")


def blank(text: str, language: str) -> str:
    """The text with comments and literals as spaces; line breaks and all positions stay, and code inside templates."""
    out, at = [], 0
    for start, end in _READERS[language](text):
        literal = text[start:end]
        out += [text[at:start], _SHOWN.sub(" ", literal) if "\n" in literal else " " * len(literal)]
        at = end
    return "".join([*out, text[at:]])


def _quoted(text: str, at: int) -> int:
    """Behind a string that ends on its line; where none does, ``at``: a quote by itself, as in running text."""
    m = _QUOTED[text[at]].match(text, at)
    return m.end() if m else at


def _upto(text: str, mark: str, at: int) -> int:
    found = text.find(mark, at)
    return len(text) if found < 0 else found + len(mark)


def _line(text: str, at: int) -> int:
    found = text.find("\n", at)
    return len(text) if found < 0 else found


def _before(text: str, at: int, spans: list[tuple[int, int]]) -> tuple[str, bool]:
    """The last word or sign of code before ``at``, and whether it is a literal; comments don't count."""
    k = len(spans) - 1
    while True:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        if k < 0 or spans[k][1] != at:
            break
        at = spans[k][0]
        if not text.startswith(("//", "/*"), at):
            return "", True
        k -= 1
    word = _WORD.search(text, max(0, at - 40), at)
    return (word[0] if word else text[max(0, at - 2) : at]), False


# Words behind which a value begins, so that a slash opens a pattern.
_AWAITING = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def _opens_pattern(text: str, at: int, spans: list[tuple[int, int]]) -> bool:
    if text.startswith("/>", at) or text.startswith("<", at - 1):
        return False
    token, literal = _before(text, at, spans)
    if literal:
        return False
    if not token:
        return True
    if token[-1].isalnum() or token[-1] in "_$":
        return token in _AWAITING
    return token not in ("++", "--") and token[-1] not in ")]"


def _javascript(text: str) -> list[tuple[int, int]]:
    spans, open_, at = [], [], 0

    def template(at: int) -> int:
        """Behind the template that goes on at ``at``, or behind the start of code in it."""
        m = _TEMPLATE.match(text, at)
        if text.startswith("${", m.end()):
            open_.append(0)
            return m.end() + 2
        return min(len(text), m.end() + 1)

    while m := _SIGNS.search(text, at):
        start, sign, end = m.start(), m[0], m.end()
        if sign == "//":
            end = _line(text, end)
        elif sign == "/*":
            end = _upto(text, "*/", end)
        elif sign == "/":
            pattern = _PATTERN.match(text, start) if _opens_pattern(text, start, spans) else None
            end = pattern.end() if pattern else start
        elif sign == "`":
            end = template(end)
        elif sign in "\"'":
            end = _quoted(text, start)
        elif sign == "{":
            if open_:
                open_[-1] += 1
            end = start
        elif open_ and not open_[-1]:
            open_.pop()
            end = template(end)
        else:
            if open_:
                open_[-1] -= 1
            end = start
        if end > start:
            spans.append((start, end))
        at = max(end, m.start() + 1)
    return spans


def _by_rules(rules: list[tuple[str, str]], ends: Callable[[str, str, re.Match], int]) -> Callable[[str], list[tuple[int, int]]]:
    """A reader for languages without nesting of code: the name of the rule that matched says where its literal ends."""
    signs = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in rules), re.S | re.M)

    def read(text: str) -> list[tuple[int, int]]:
        spans, at = [], 0
        while m := signs.search(text, at):
            end = ends(m.lastgroup, text, m)
            if end > m.start():
                spans.append((m.start(), end))
            at = max(end, m.start() + 1)
        return spans

    return read


def _ends(kind: str, text: str, m: re.Match) -> int:
    if kind == "line":
        return _line(text, m.end())
    if kind == "block":
        return _upto(text, "*/", m.end())
    if kind == "nested":
        depth, at = 1, m.end()
        for mark in re.compile(r"/\*|\*/").finditer(text, m.end()):
            depth, at = depth + (1 if mark[0] == "/*" else -1), mark.end()
            if not depth:
                return at
        return len(text)
    if kind == "raw":
        return _upto(text, '"' + m["hashes"], m.end())
    if kind == "back":
        return _upto(text, "`", m.end())
    if kind == "lines":
        closed = re.compile(r'(?:\\.|[^"\\])*"', re.S).match(text, m.end())
        return closed.end() if closed else len(text)
    if kind == "quoted":
        return _quoted(text, m.start())
    return m.end()


# Ruby: what closes what is opened in literals with a percent sign.
_CLOSES = {"(": ")", "[": "]", "{": "}", "<": ">"}
_RUBY_SIGNS = re.compile(r"^=begin\b|^__END__$|<<[~-]?([\"'`]?)([A-Za-z_]\w*)\1|%[wWiIqQrsx]?[^\w\s=]|\$[\"'`/]|\?[\"'`#/](?!\w)|[#\"'`/{}\n]", re.M)
_RUBY_AWAITING = frozenset("if unless while until and or not return when then in do case else elsif puts p raise yield".split())


def _ruby(text: str) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    _ruby_code(text, 0, spans, None)
    return spans


def _ruby_value(text: str, at: int, spans: list[tuple[int, int]]) -> bool:
    """Whether a value may begin at ``at``, so that a slash or a percent sign opens a literal."""
    head = text[:at] if at < 60 else text[at - 60 : at]
    bare = head.rstrip(" \t")
    if not bare or bare[-1] == "\n":
        return True
    if spans and spans[-1][1] == at - (len(head) - len(bare)):
        return False
    word = re.search(r"[\w?!@$]+\Z", bare)
    if word:
        spaced = len(bare) < len(head) and at + 1 < len(text) and not text[at + 1].isspace() and text[at + 1] != "="
        return word[0] in _RUBY_AWAITING or (spaced and (word[0][0].islower() or word[0][0] == "_"))
    return bare[-1] not in ")]}"


def _ruby_code(text: str, at: int, spans: list[tuple[int, int]] | None, depth: int | None) -> int:
    """Read code up to the end, or (with ``depth``: that of interpolations) up to the brace that closes it."""
    own, braces, waiting = [] if spans is None else spans, 0, []
    while m := _RUBY_SIGNS.search(text, at):
        start, sign, end = m.start(), m[0], m.end()
        if sign == "\n":
            end = start
            if waiting:
                end = start + 1
                for word, indented in waiting:
                    close = re.compile(rf"^{'[ \t]*' if indented else ''}{word}$", re.M).search(text, end)
                    end = close.end() if close else len(text)
                waiting = []
        elif sign == "=begin":
            close = re.compile(r"^=end\b[^\n]*", re.M).search(text, end)
            end = close.end() if close else len(text)
        elif sign == "__END__":
            end = len(text)
        elif sign == "#":
            end = _line(text, start)
        elif sign.startswith("<<"):
            constant = m[2].isupper() and re.search(r"(?:^|[\s(,=])\Z", text[max(0, start - 1) : start])
            if sign[2] in "~-" or m[1] or constant:
                waiting.append((m[2], sign[2] in "~-"))
            else:
                end = start
        elif sign in ("{", "}"):
            if sign == "}" and not braces and depth is not None:
                return end
            braces, end = max(0, braces + (1 if sign == "{" else -1)), start
        elif sign[0] == "%":
            adjoining = start > 0 and re.match(r"[\w)\]}]", text[start - 1])
            if adjoining or not _ruby_value(text, start, own):
                end = start
            else:
                end = _ruby_literal(text, end, sign[-1], sign[1] not in "qwis", depth or 0)
        elif sign == "/":
            closed = re.compile(r"(?:\\.|[^/\\\n])*/").match(text, end)
            end = _ruby_literal(text, end, "/", True, depth or 0) if closed and _ruby_value(text, start, own) else start
        elif sign[0] in "$?":
            if sign[0] == "?" and start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_)]"):
                end = start + 1  # a method that ends so, or a condition
                at = end
                continue
        else:
            end = _ruby_literal(text, end, sign, sign != "'", depth or 0)
        if end > start:
            own.append((start, end))
        at = max(end, start + 1)
    return len(text)


def _ruby_literal(text: str, at: int, opened: str, interpolated: bool, depth: int) -> int:
    """Behind a literal that ``opened`` has opened; brackets nest, and code in it may hold literals again."""
    close, inside = _CLOSES.get(opened, opened), 0
    signs = re.compile(rf"\\.|#\{{|{re.escape(close)}" + (rf"|{re.escape(opened)}" if close != opened else ""), re.S)
    while m := signs.search(text, at):
        at = m.end()
        if m[0] == "#{":
            if interpolated and depth < DEEPEST:
                at = _ruby_code(text, at, None, depth + 1)
            elif close == "}":
                inside += 1
        elif m[0] == close:
            if not inside:
                return at
            inside -= 1
        elif m[0] == opened:
            inside += 1
    return len(text)


_READERS = {
    "javascript": _javascript,
    "java": _by_rules([("line", "//"), ("block", r"/\*"), ("text", r'"""(?:\\.|.)*?(?:"""|\Z)'), ("quoted", '"'), ("character", r"'(?:\\[^\n']+|\\'|[^'\\\n])'")], _ends),
    "go": _by_rules([("line", "//"), ("block", r"/\*"), ("back", "`"), ("quoted", '"'), ("character", r"'(?:\\[^\n']+|\\'|[^'\\\n])'")], _ends),
    "rust": _by_rules([("line", "//"), ("nested", r"/\*"), ("raw", r'\b(?:br|cr|r)(?P<hashes>#*)"'), ("lines", r'"'), ("character", r"'(?:\\[^\n']+|\\'|[^'\\\n])'")], _ends),
    "ruby": _ruby,
}
