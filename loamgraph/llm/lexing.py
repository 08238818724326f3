"""Lexers of six languages: significant tokens, comments, and the first lexical fault of a file.

A token is a tuple (kind, text, start, line): kinds are ``i`` identifier or keyword, ``d`` number, ``s`` string, ``p`` operator
or delimiter, ``m`` merge-conflict marker. Comments are (text, start, first line, last line). Lines count from 1.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

# Languages by file extension.
LANGUAGES = {
    "js": "js", "mjs": "js", "cjs": "js", "ts": "ts", "mts": "ts", "cts": "ts",
    "py": "py", "pyi": "py", "java": "java", "rs": "rs", "go": "go",
}


def language_of(path: str | None) -> str | None:
    """Language of a path's extension; None if it has none that is known."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


_MARKER = r"(?P<m>(?m:^)(?:<{7}|={7}|>{7}|\|{7})(?=[ \t\r\n]|\Z))"
_SPACE = r"(?P<w>[ \t\f\v\u00a0\ufeff\u2000-\u200b\u3000]+|\r\n?|[\n\u2028\u2029])"
_C_COMMENT = r"(?P<c>//[^\r\n]*|/\*[\s\S]*?\*/)"
_WORD = r"(?P<i>[^\W\d][\w]*)"
_DQ = r'"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"'
_SQ = r"'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'"
_JS_NUMBER = r"(?P<d>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"

_PATTERNS = {
    "js": rf"{_MARKER}|{_SPACE}|{_C_COMMENT}|(?P<i>#?(?:[^\W\d]|\$)[\w$]*)|{_JS_NUMBER}|(?P<s>{_DQ}|{_SQ})"
    r"|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
    "java": rf"{_MARKER}|{_SPACE}|{_C_COMMENT}|(?P<i>[^\W\d][\w$]*|\$[\w$]*)|(?P<d>0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?)"
    r'|(?P<s>"""[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?"""|(?!""")"(?:[^"\\\r\n]|\\[^\r\n])*"|' r"'(?:[^'\\\r\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))')"
    r"|(?P<p>>>>=|\.\.\.|<<=|>>=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
    "rs": rf"{_MARKER}|{_SPACE}|(?P<c>//[^\r\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)|(?P<s>b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\r\n\t]|\\(?:x[\da-fA-F]{{2}}|u\{{[\da-fA-F_]+\}}|.))'|'[^\W\d]\w*)"
    r"|(?P<i>(?:r#)?[^\W\d]\w*)|(?P<d>0x[\da-fA-F_]+(?:[iu](?:\d+|size))?|0[bo][0-7_]+(?:[iu](?:\d+|size))?|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*)?(?:[iuf](?:\d+|size))?)"
    r"|(?P<p>\.\.\.|\.\.=|<<=|>>=|\.\.|->|=>|::|==|!=|<=|>=|&&|\|\||[-+*/%&|^]=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@#$])",
    "go": rf"{_MARKER}|{_SPACE}|{_C_COMMENT}|{_WORD}|(?P<d>0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?i?)"
    r"|(?P<s>`[^`]*`|" rf"{_DQ}" r"|'(?:[^'\\\r\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|.))')"
    r"|(?P<p><<=|>>=|&\^=|\.\.\.|:=|<-|&\^|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<<|>>|[{}()\[\];,<>+\-*/%&|^!~?:=.])",
    "py": rf"{_MARKER}|(?P<w>[ \t\f\ufeff]+|\\\r?\n|\r\n?|\n)|(?P<c>\#[^\r\n]*)"
    r"|(?P<s>(?:[rRbBuUfFtT]{1,2})?(?:'''(?:[^\\]|\\[\s\S])*?'''|" r'"""(?:[^\\]|\\[\s\S])*?"""|' rf"(?!''')(?!\"\"\")(?:{_DQ}|{_SQ})))"
    rf"|{_WORD}|(?P<d>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)"
    r"|(?P<p>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%&|^@]=|[{}()\[\];,<>+\-*/%&|^~:=.@!])",
}
_PATTERNS["ts"] = _PATTERNS["js"]
_MATCH: dict[str, re.Pattern] = {}
_SPACES = {"py": r"(?:[ \t\f\ufeff\r\n]|\\\r?\n)*+", "": r"[ \t\f\v\r\n\u00a0\ufeff\u2000-\u200b\u2028\u2029\u3000]*+"}
_FIND: dict[str, tuple] = {}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-z]*")
_NEWLINE = re.compile(r"\r\n?|\n")
_RUST_COMMENT = re.compile(r"/\*|\*/")
# JavaScript words after which a slash starts a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}


class Lexed(NamedTuple):
    tokens: list[tuple[str, str, int, int]]
    comments: list[tuple[str, int, int, int]]
    fault: str | None  # first lexical fault
    starts: list[int]  # offsets of line starts


def line_starts(text: str) -> list[int]:
    if "\r" in text:
        return [0, *(m.end() for m in _NEWLINE.finditer(text))]
    starts, at = [0], text.find("\n") + 1
    while at:
        starts.append(at)
        at = text.find("\n", at) + 1
    return starts


def _template_end(text: str, pos: int, lang: str, depth: int = 0) -> int:
    """End of the template literal that starts at ``pos``; -1 if it does not end."""
    k, n = pos + 1, len(text)
    while k < n:
        ch = text[k]
        if ch == "\\":
            k += 2
        elif ch == "`":
            return k + 1
        elif ch == "$" and text.startswith("{", k + 1):
            k, level = k + 2, 1
            while level:
                if k >= n or depth > 50:
                    return -1
                if text[k] == "`":
                    if (k := _template_end(text, k, lang, depth + 1)) < 0:
                        return -1
                    continue
                m = _pattern(lang).match(text, k)
                if m is None:
                    return -1
                if m.lastgroup == "p":
                    level += (m[0] == "{") - (m[0] == "}")
                k = m.end()
        else:
            k += 1
    return -1


def _pattern(lang: str) -> re.Pattern:
    if lang not in _MATCH:
        _MATCH[lang] = re.compile(_PATTERNS[lang])
    return _MATCH[lang]


def _unmatched(text: str, pos: int, lang: str) -> str:
    two = text[pos : pos + 2]
    if two == "/*":
        return "unterminated comment"
    if text[pos] in "\"'`" or lang == "rs" and two in ('b"', 'r"', "r#"):
        return "unterminated literal"
    return "illegal character"


def _finder(lang: str) -> tuple[re.Pattern, re.Pattern, list[str]]:
    """A pattern of white space and the token after it, one of white space alone, and the kind of token of each group."""
    if lang not in _FIND:
        spaces = _SPACES.get(lang, _SPACES[""])
        tokens = re.sub(r"\(\?P<w>(?:\\.|\[(?:\\.|[^\]])*\]|[^)\\\[])*\)\|", "", _PATTERNS[lang], count=1)
        find = re.compile(rf"{spaces}(?:{tokens})")
        kinds = [""] * (find.groups + 1)
        for name, k in find.groupindex.items():
            kinds[k] = name
        _FIND[lang] = find, re.compile(spaces), kinds
    return _FIND[lang]


def lex(lang: str, text: str) -> Lexed:
    """All tokens of the file; after a lexical fault the lexer skips a character (or, in an unterminated literal, the line) and goes on."""
    find, spaces, kinds = _finder(lang)
    tokens, comments, fault = [], [], None
    starts = line_starts(text)
    pos, n, script, py = 0, len(text), lang in ("js", "ts"), lang == "py"
    if text.startswith("#!") and not (lang == "rs" and text.startswith("#![")):
        pos = starts[1] if len(starts) > 1 else n
    line, ends = 1, [*starts[1:], n + 1]  # the line of the current token, and where each line ends
    line_of = bisect_right
    add = tokens.append
    while pos < n:
        odd = -1  # where no token of the pattern stands, or one that needs a closer look
        for m in find.finditer(text, pos):
            group = m.lastindex
            kind, (start, end) = kinds[group], m.span(group)
            if m.start() != pos:
                odd = spaces.match(text, pos).end()
                break
            while start >= ends[line - 1]:
                line += 1
            if kind == "i":
                pos = end
                add(("i", text[start:end], start, line))
            elif kind == "p":
                mark = text[start:end]
                if mark[0] == "/" and not py:
                    if text.startswith("/*", start):
                        odd = start
                        break
                    if script:
                        last = tokens[-1] if tokens else None
                        if last is None or last[0] == "p" and last[1] not in ")]}" and last[1] not in ("++", "--") or last[0] == "i" and last[1] in _BEFORE_REGEX:
                            if r := _REGEX.match(text, start):
                                add(("s", r[0], start, line))
                                pos = r.end()
                                break
                pos = end
                add(("p", mark, start, line))
            elif kind == "c":
                pos = end
                comments.append((text[start:end], start, line, line_of(starts, pos - 1)))
            else:
                pos = end
                if kind == "m":
                    fault = fault or f"merge-conflict marker at line {line}"
                elif kind == "d" and pos < n and (text[pos].isalpha() or text[pos] == "_"):
                    if not (py and re.match(r"(?:if|else|and|or|in|is|for|not)\b", text[pos : pos + 5])):
                        fault = fault or f"malformed number at line {line}"
                add((kind, text[start:end], start, line))
        else:
            odd = spaces.match(text, pos).end()
        if odd < 0:
            continue
        if odd >= n:
            break
        pos = odd
        line = line_of(starts, pos)
        if script and text[pos] == "`":
            end = _template_end(text, pos, lang)
            if end > 0:
                add(("s", text[pos:end], pos, line))
                pos = end
                continue
        if lang == "rs" and text.startswith("/*", pos):  # comments nest
            level, end = 0, n
            for c in _RUST_COMMENT.finditer(text, pos):
                level += 1 if c[0] == "/*" else -1
                if not level:
                    end = c.end()
                    break
            if not level:
                comments.append((text[pos:end], pos, line, line_of(starts, end - 1)))
                pos = end
                continue
        fault = fault or f"{_unmatched(text, pos, lang)} at line {line}"
        cut = text[pos] in "\"'`"
        whole = not py and text.startswith("/*", pos)
        pos = n if whole else (starts[line] if line < len(starts) else n) if cut else pos + 1
    return Lexed(tokens, comments, fault, starts)
