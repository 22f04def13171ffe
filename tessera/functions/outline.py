"""Definitions and branches of source texts in languages with braces, and of Ruby, without a parser.

Comments and literals are blanked by a lexer, brackets matched, and headers of definitions looked for where no bracket is
open; parameters of types and braces that belong to types are passed over. This finds what a parser finds in texts that
are formatted the usual way; a text in which nothing is found is split by characters, as one that does not parse.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

from tessera.functions import lexer

# Languages by extension; definitions at the top of a file, and of those the ones that are split into methods.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust", ".rb": "ruby"}

_MARKS = r"(?:@[\w.]+(?:\([^()]*\))?\s+)*"
_JS_HEAD = _MARKS + r"(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:(?:async\s+)?(?P<function>function)\b\s*\*?\s*|(?:abstract\s+)?(?P<class>class)\s+|{more}(?(export)|(?!)))(?P<name>[\w$]*)"
_HEADS = {
    "javascript": _JS_HEAD.replace("{more}", r"(?P<line>(?:const|let)\s+(?=[\w$]))(?P<bare>)|(?P<other>(?:(?:const\s+)?enum\s+|namespace\s+)?)").replace(r"(?(export)|(?!))", r"(?:(?(bare)|(?(export)|(?!))))"),
    "typescript": _JS_HEAD.replace("{more}", r"(?P<block>interface\s+)(?P<bare>)|(?P<line>type\s+(?=[\w$]))(?P<bare2>)|(?P<other>(?:(?:const\s+)?enum\s+|namespace\s+|(?:const|let|var)\s+)?)").replace(r"(?(export)|(?!))", r"(?:(?(bare)|(?(bare2)|(?(export)|(?!)))))"),
    "java": _MARKS + r"(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*(?:(?P<class>class)|(?P<block>interface|enum))\s+(?P<name>\w+)",
    "go": r"(?:(?P<function>func)\s*(?:\([^)]*\)\s*)?(?P<name>\w+)|(?P<line>type)\s+(?P<name2>\w*))",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*(?P<function>fn)\s+(?P<name>\w+)|(?:unsafe\s+)?(?P<block>(?P<impl>impl\b)|(?:struct|enum|trait)\s+)(?P<name2>[\w:]*))",
}
_HEADS["tsx"] = _HEADS["typescript"]
_HEADS = {k: re.compile(v) for k, v in _HEADS.items()}
_METHODS = {
    "javascript": re.compile(_MARKS + r"(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set|declare)\s+(?=[\w$#*\[]))*\*?\s*(?P<name>[\w$#]+)\s*\??\s*(?=[(<])"),
    "java": re.compile(_MARKS + r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>(){}]*>\s*)?(?:[\w.<>,\[\]?&]+(?:\s+[\w.<>,\[\]?&]+)*\s+)?(?P<name>\w+)\s*(?=\()"),
}
_RUBY_WORDS = re.compile(r"(?<![.\w@$:?!])(class|module|def|if|unless|while|until|for|case|begin|do|end)\b(?![?!]|:(?!:))")
_ENDLESS = re.compile(r"def\s+(?:self\.)?\w+[?!]?\s*(?:\((?:[^()]|\([^()]*\))*\))?\s+=\s")
# Words behind which a condition opens a block of its own; behind any other word it closes a statement.
_RUBY_BEFORE = frozenset("then do else and or not when in begin ensure".split())


def family(language: str) -> str:
    return "javascript" if language in ("typescript", "tsx") else language


def blank(text: str, language: str) -> str:
    """The text with comments and literals as spaces; line breaks and all positions stay."""
    return lexer.blank(text, family(language))


_BRACKETS = re.compile(r"[()\[\]{}]")


def matched(code: str) -> dict[int, int]:
    """The closing place of each opening bracket; those that stay open end with the text."""
    open_, out = [], {}
    closes = {")": "(", "]": "[", "}": "{"}
    for m in _BRACKETS.finditer(code):
        sign, at = m[0], m.start()
        if sign in "([{":
            open_.append((sign, at))
            out[at] = len(code)
            continue
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] == closes[sign]:
                out[open_[k][1]] = at
                del open_[k:]
                break
    return out


@lru_cache(1)
def _read(text: str, language: str) -> tuple[str, dict[int, int]]:
    """The blanked text and its brackets; kept for the last text, whose classes ask again."""
    code = blank(text, language)
    return code, matched(code)


@dataclass
class Definition:
    kind: str
    name: str
    start: int
    end: int
    body: tuple[int, int] | None = None


def _until(code: str, pairs: dict[int, int], at: int, stops: str, upto: int) -> int:
    """The first of ``stops`` outside brackets, at or after ``at``; ``upto`` if there is none."""
    while at < upto:
        if code[at] in stops:
            return at
        at = pairs[at] + 1 if at in pairs else at + 1
    return upto


def _past_types(code: str, pairs: dict[int, int], at: int, upto: int) -> int:
    """Behind the angle brackets that open at ``at`` (blanks before them allowed); ``at`` if there are none or they stay open."""
    start = at
    while at < upto and code[at].isspace():
        at += 1
    if at >= upto or code[at] != "<":
        return start
    depth = 0
    while at < upto:
        if code[at] == "<":
            depth += 1
        elif code[at] == ">" and code[at - 1] not in "=-":
            depth -= 1
            if not depth:
                return at + 1
        elif code[at] == ";" or code[at] in ")]}":
            return start
        at = pairs[at] + 1 if at in pairs else at + 1
    return start


def _block(code: str, pairs: dict[int, int], at: int, stops: str) -> int:
    """As ``_until``, with parameters of types passed over: for what a class extends."""
    while True:
        at = _until(code, pairs, at, stops + "<", len(code))
        if at >= len(code) or code[at] != "<":
            return at
        at = max(_past_types(code, pairs, at, len(code)), at + 1)


# Signs and words behind which a brace belongs to a type.
_TYPE_BRACE = {"javascript": re.compile(r"(?:(?<![=!<>]):|[|&]|\bextends|\bis)\s*\Z"), "go": re.compile(r"\b(?:interface|struct)\s*\Z")}


def _body(code: str, pairs: dict[int, int], at: int, stops: str, upto: int, language: str) -> int:
    """As ``_until``, with braces of types passed over."""
    of_type = _TYPE_BRACE.get(family(language))
    while True:
        stop = _until(code, pairs, at, stops, upto)
        if stop >= upto or code[stop] != "{" or not of_type or not of_type.search(code, max(at, stop - 40), stop):
            return stop
        at = pairs[stop] + 1


def _line_end(code: str, pairs: dict[int, int], at: int, upto: int) -> int:
    """Where a statement that needs no semicolon ends."""
    while True:
        at = _until(code, pairs, at, ";\n", upto)
        if at >= upto or code[at] == ";":
            return min(upto, at + 1)
        before, after = code[:at].rstrip()[-1:], code[at:upto].lstrip()[:1]
        if before not in tuple("=+-*/|&?:,.<>(") and after not in tuple("|&?:.+"):
            return at
        at += 1


def definitions(text: str, language: str) -> list[Definition]:
    """Definitions at the top of a text in order; a body is given for classes that can be split into methods."""
    if language == "ruby":
        return _ruby(blank(text, language), text)
    code, pairs = _read(text, language)
    out, at = [], 0
    while at < len(code):
        if code[at].isspace():
            at += 1
            continue
        head = _HEADS[language].match(code, at)
        if not head or head.end() == at:
            nl = _until(code, pairs, at, "\n;", len(code))
            at = nl + 1
            continue
        found = head.groupdict()
        name = found.get("name") or found.get("name2") or ""
        kind = "class" if found.get("class") else "function"
        if found.get("function") or found.get("class") or found.get("block"):
            after = _past_types(code, pairs, head.end(), len(code))
            if found.get("impl"):
                name = re.compile(r"\s*([\w:]*)").match(code, after)[1]
            stop = _block(code, pairs, after, "{;") if found.get("class") or found.get("block") else _body(code, pairs, after, "{;", len(code), language)
            body = (stop + 1, pairs[stop]) if stop < len(code) and code[stop] == "{" else None
            end = min(len(code), pairs[stop] + 1 if body else stop + 1)
        else:
            body, end = None, _line_end(code, pairs, head.end(), len(code))
        out.append(Definition(kind, name, at, end, body if kind == "class" else None))
        at = max(end, at + 1)
    return out


def methods(text: str, language: str, body: tuple[int, int]) -> list[Definition]:
    """Methods of a class body, with or without a block."""
    code, pairs = _read(text, language)
    out, at, upto = [], body[0], body[1]
    while at < upto:
        if code[at].isspace() or code[at] in ";}":
            at += 1
            continue
        head = _METHODS[family(language)].match(code, at, upto)
        opened = _past_types(code, pairs, head.end(), upto) if head else upto
        end = None
        while opened < upto and code[opened].isspace():
            opened += 1
        if head and opened < upto and code[opened] == "(":
            after = pairs.get(opened, upto) + 1
            stop = _body(code, pairs, after, "{;=\n" if family(language) == "javascript" else "{;=", upto, language)
            if stop < upto and code[stop] == "\n" and code[stop:upto].lstrip()[:1] == "{":
                stop += len(code[stop:upto]) - len(code[stop:upto].lstrip())
            if stop < upto and code[stop] == "{":
                end = min(upto, pairs[stop] + 1)
            elif stop < upto and code[stop] == ";":
                end = stop + 1
        if end is not None:
            out.append(Definition("method", head["name"], at, end))
            at = end
        else:
            at = _line_end(code, pairs, at, upto)
            at += at < upto and code[at] == "\n"
    return out


def _ruby_trailing(code: str, text: str, at: int) -> bool:
    """Whether a condition at ``at`` follows a statement on its line, and so has no end of its own."""
    before = text[text.rfind("\n", 0, at) + 1 : at].rstrip()
    if not before:
        return False
    last = code[at - len(text[text.rfind("\n", 0, at) + 1 : at]) + len(before) - 1]
    if last.isspace():  # a literal
        return True
    word = re.search(r"[\w?!]+\Z", before)
    return word[0] not in _RUBY_BEFORE if word else last in ")]}"


def _ruby_ends(code: str, text: str) -> list[tuple[str, int, int, int]]:
    """(keyword, start, end, depth) of blocks that end closes, and of methods without one."""
    open_, out, loop = [], [], -1
    for m in _RUBY_WORDS.finditer(code):
        word, at = m[1], m.start()
        if re.search(r"\bdef\s\Z", code[max(0, at - 5) : at]):
            continue
        if word == "end":
            if open_:
                opened, start = open_.pop()
                out.append((opened, start, m.end(), len(open_)))
        elif word == "def" and _ENDLESS.match(code, at):
            nl = code.find("\n", at)
            out.append((word, at, nl if nl >= 0 else len(code), len(open_)))
        elif word == "do" and loop >= 0 and code.find("\n", loop, at) < 0:
            loop = -1
        elif word not in ("if", "unless", "while", "until") or not _ruby_trailing(code, text, at):
            open_.append((word, at))
            loop = at if word in ("while", "until", "for") else loop
    return sorted(out, key=lambda x: x[1])


def _ruby(code: str, text: str) -> list[Definition]:
    out = []
    for word, start, end, depth in _ruby_ends(code, text):
        if depth == 0 and word in ("def", "class", "module"):
            name = re.compile(r"\w+\s+(?:self\.)?([\w:]+[?!=]?)").match(code, start)
            out.append(Definition("function", name[1] if name else "", start, end))
    return out


_FUNCTION = {
    "javascript": re.compile(r"\bfunction\b\s*\*?\s*(?P<name>[\w$]*)|(?P<arrow>=>)|(?P<class>\bclass\b)"),
    "java": re.compile(r"(?P<class>\b(?:class|interface|enum|record)\b)"),
    "go": re.compile(r"\bfunc\s*(?:\([^)]*\)\s*)?(?P<name>\w+)"),
    "rust": re.compile(r"\bfn\s+(?P<name>\w+)"),
}
_BRANCH = {
    "javascript": re.compile(r"\b(?:if|for|while|case|catch)\b"),
    "java": re.compile(r"\b(?:if|for|while|case|default(?=\s*(?:->|:))|catch)\b"),
    "go": re.compile(r"\b(?:if|for|select|case)\b|\.\(\s*type\s*\)"),
    "rust": re.compile(r"\b(?:if(?![^{};]*=>)|for(?!\s*<)|while|loop)\b|=>"),
    "ruby": re.compile(r"^[ \t]*(?:elsif|rescue|when)\b", re.M),
}


def branches(code: str, language: str) -> int:
    """Branches in blanked code (of Ruby those that open no block)."""
    n = len(_BRANCH[family(language)].findall(code))
    if language == "go":  # what a select waits for is no case of its own
        pairs = matched(code)
        for m in re.finditer(r"\bselect\b\s*(?=\{)", code):
            n -= len(re.findall(r"\bcase\b", code[m.end() : pairs[m.end()]]))
    return n


def functions(text: str, language: str) -> list[tuple[str, int, int]]:
    """(name, line, 1 + branches) of the outermost functions and methods, most complex first."""
    code = blank(text, language)
    pairs, spans, forks = matched(code), [], []
    opens = {b: a for a, b in pairs.items()}
    if language == "ruby":
        blocks = _ruby_ends(code, text)
        forks = [s for w, s, _, _ in blocks if w in ("if", "unless", "while", "until", "for")]
        spans = [(s, e, re.compile(r"def\s+(?:self\.)?([\w]+[?!=]?)").match(code, s)) for w, s, e, _ in blocks if w == "def"]
        spans = [(s, e, m[1] if m else "") for s, e, m in spans]
    else:
        for m in _FUNCTION[family(language)].finditer(code):
            found = m.groupdict()
            if found.get("class"):
                named = re.compile(r"\s*[\w$]*").match(code, m.end())
                stop = _block(code, pairs, named.end(), "{;)")
                if stop < len(code) and code[stop] == "{" and family(language) in _METHODS:
                    spans += [(d.start, d.end, d.name) for d in methods(text, language, (stop + 1, pairs[stop]))]
            elif found.get("arrow"):
                start = _arrow_start(code, opens, m.start())
                after = m.end() + len(code[m.end() :]) - len(code[m.end() :].lstrip())
                end = pairs[after] + 1 if after < len(code) and code[after] == "{" and after in pairs else _until(code, pairs, after, ",;)]}\n", len(code))
                named = re.search(r"([\w$]+)\s*(?::[^=;{}]*)?=\s*(?:async\s*)?$", code[max(0, start - 120) : start])
                spans.append((start, end, named[1] if named else text[start : start + 40].split("\n")[0].strip()))
            else:
                stop = _body(code, pairs, _past_types(code, pairs, m.end(), len(code)), "{;", len(code), language)
                if stop < len(code) and code[stop] == "{":
                    spans.append((m.start(), pairs[stop] + 1, found.get("name") or ""))
    out, upto = [], -1
    for start, end, name in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= upto:
            out.append((name, text.count("\n", 0, start) + 1, 1 + branches(code[start:end], language) + bisect_left(forks, end) - bisect_left(forks, start)))
            upto = end
    return sorted(out, key=lambda x: -x[2])


def _arrow_start(code: str, opens: dict[int, int], arrow: int) -> int:
    """Where the parameters before an arrow begin; ``opens`` leads from closing brackets back."""
    at = arrow
    while at > 0 and code[at - 1].isspace():
        at -= 1
    if code[at - 1 : at] == ")":
        return opens.get(at - 1, arrow)
    start = at
    while start > 0 and (code[start - 1].isalnum() or code[start - 1] in "_$"):
        start -= 1
    return start if start < at else arrow
