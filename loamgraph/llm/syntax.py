"""Source files that do not parse: lexer with a pushdown stack per language.

The stack holds the open delimiters and what each encloses (a parameter list, an object literal, a class body, a block).
Besides unterminated literals, unbalanced delimiters, premature ends and merge-conflict markers it reports what no grammar
of the language allows next to each other: two operands without an operator, an operator without an operand, a statement
keyword where none can stand, a declaration that another language would write. Python, whose blocks are indentation, is
lexed the same way and then read by the interpreter's own parser as the exact check.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.lexing import Lexed, language_of, lex
from loamgraph.session import ship

_CLOSERS = {")": "(", "]": "[", "}": "{"}
# Reserved words and operators of the languages.
_JS_KEYWORDS = set(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return static super switch this throw try typeof var void while with yield await async of get set as from enum".split()
)
_TS_WORDS = set("type interface namespace module declare abstract readonly public private protected override is keyof infer asserts satisfies implements unique accessor out global require".split())
_JS_VALUES = {"this", "super", "null", "true", "false"}
_JS_HEADS = {"if", "for", "while", "switch", "catch", "with"}
_JS_BINARY = set("* / % = == === != !== <= >= && || ?? & | ^ << >> >>> ** += -= *= /= %= &= |= ^= <<= >>= >>>= &&= ||= ??= **= . ?. => ? > :".split())
_JAVA_KEYWORDS = set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var record sealed permits yield when non".split()
)
_JAVA_TYPES = {"boolean", "byte", "char", "double", "float", "int", "long", "short", "void", "var", "this", "super", "class"}
_JAVA_TOP = {"package", "import", "public", "abstract", "final", "class", "interface", "enum", "record", "sealed", "non", "strictfp"}
_JAVA_STATEMENT = {"if", "for", "while", "do", "switch", "try", "throw", "break", "continue", "return", "import", "package", "private", "protected", "public", "static"}
_RUST_KEYWORDS = set(
    "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type unsafe use where while macro_rules union default auto safe raw".split()
)
_RUST_TOP = {"use", "pub", "fn", "struct", "enum", "impl", "mod", "const", "static", "trait", "type", "extern", "unsafe", "async", "macro_rules", "union", "crate", "self", "super", "default", "auto"}
_RUST_STATEMENT = {"let", "fn", "use", "struct", "enum", "trait", "return", "while", "loop", "pub", "impl", "static"}
_GO_KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_TOP = {"import", "func", "var", "const", "type"}


class Fault(Exception):
    pass


def _balance(tokens) -> None:
    stack = []
    for kind, text, _, line in tokens:
        if kind == "p":
            if text in "([{":
                stack.append((text, line))
            elif text in _CLOSERS:
                if not stack or stack[-1][0] != _CLOSERS[text]:
                    raise Fault(f"unbalanced {text} at line {line}")
                stack.pop()
    if stack:
        raise Fault(f"premature end: {stack[-1][0]} of line {stack[-1][1]} is not closed")


def _check_script(lx: Lexed, ts: bool) -> None:
    tokens, n = lx.tokens, len(lx.tokens)
    words = _JS_KEYWORDS | _TS_WORDS if ts else _JS_KEYWORDS
    stack: list[list] = []  # [opener, what it encloses, ternaries open, value of a flag]
    tern, cases, awaiting, pending = 0, 0, "", ""
    pk, pt, pline, plain, head_close = "", "", 0, False, False  # the token before; plain: an operand that is no keyword
    ppt = ""
    for k in range(n):
        kind, text, _, line = tokens[k]
        nxt = tokens[k + 1][1] if k + 1 < n else ""
        inside = stack[-1][1] if stack else "top"
        newline = line != pline
        if awaiting:  # words or delimiters that must come next
            if awaiting == "catch":
                if text not in ("catch", "finally"):
                    raise Fault(f"try without catch at line {line}")
            elif awaiting == "body":
                if text != "{" and not (ts and (text in (":", ";") or newline)):
                    raise Fault(f"function without a body at line {line}")
            awaiting = ""
        if kind == "i" or kind == "d" or kind == "s":
            value = kind != "i" or text not in words
            if pk in ("d", "s") and not newline or pk in ("d", "s") and inside in ("(", "[", "object"):
                if not (kind == "i" and (text in ("in", "of", "instanceof", "as", "is", "satisfies", "from", "extends") or text in words and inside == "class")):
                    raise Fault(f"operand after operand at line {line}")
            elif plain and pk == "i" and value and (not newline or inside in ("(", "[", "object")) and not (kind == "s" and text[0] == "`"):
                raise Fault(f"operand after operand at line {line}")
            elif pt in (")", "]") and pk == "p" and value and not head_close and (not newline or inside in ("(", "[", "object")) and not (kind == "s" and text[0] == "`"):
                raise Fault(f"operand after {pt} at line {line}")
            elif plain and not newline and kind == "i" and text in ("return", "if", "while", "const", "let", "var", "function", "throw", "import", "export", "for", "try", "switch") and pt not in ("get", "set", "static") and ppt not in (".", "?.", "@"):
                raise Fault(f"keyword {text} after operand at line {line}")
            if pk == "p" and pt in (".", "?.") and kind != "i":
                raise Fault(f"{text} after a dot at line {line}")
            if kind == "i" and pt not in (".", "?.") and nxt not in (":", "?") or kind == "i" and text in ("import", "export") and pt not in (".", "?."):
                if nxt not in (":", "=", ",", ")") or text in ("const", "import", "export", "function", "if", "while", "for", "switch"):
                    if text in _JS_HEADS and not (inside in ("class", "object")):
                        if nxt != "(" and not (text == "catch" and nxt == "{") and not (text == "for" and nxt == "await"):
                            raise Fault(f"{text} without a head at line {line}")
                        pending = "head"
                    elif text in ("try", "finally") and inside not in ("class", "object"):
                        if nxt != "{":
                            raise Fault(f"{text} without a block at line {line}")
                        pending = text
                    elif text == "do" and inside not in ("class", "object") or text == "else":
                        if not nxt or nxt in ")]}":
                            raise Fault(f"{text} without a statement at line {line}")
                    elif text == "function":
                        if nxt not in ("(", "*") and (k + 1 >= n or tokens[k + 1][0] != "i"):
                            raise Fault(f"function without a name at line {line}")
                        pending = "function"
                    elif text in ("class", "interface", "namespace", "module") and (k + 1 < n and (tokens[k + 1][0] in "is" or nxt == "{")) and (text == "class" or ts):
                        pending = "class" if text in ("class", "interface") else "namespace"
                    elif text == "enum" and ts:
                        pending = "object"
                    elif text == "switch":
                        pending = "head"
                    elif text in ("case", "default") and inside in ("block", "top"):
                        cases += text == "case" or nxt == ":"
                    elif text in ("const", "var") or text == "let":
                        if k + 1 >= n or tokens[k + 1][0] != "i" and nxt not in ("{", "["):
                            raise Fault(f"{text} without a name at line {line}")
                        after = tokens[k + 2][1] if k + 2 < n else ""
                        if text == "const" and tokens[k + 1][0] == "i" and nxt != "enum" and after not in ("=", "of", "in") and not (ts and after in (":", "!")):
                            raise Fault(f"const without a value at line {line}")
                        if not ts and tokens[k + 1][0] == "i" and after == ":":
                            raise Fault(f"type annotation at line {line}")
                    elif text in ("import", "export"):
                        if k + 1 >= n:
                            raise Fault(f"premature end after {text}")
                        if inside not in ("top", "namespace") and not (text == "import" and nxt in ("(", ".")) and inside not in ("class", "object"):
                            raise Fault(f"{text} inside a block at line {line}")
                        if text == "import" and nxt not in ("(", ".", "{", "*", "type") and tokens[k + 1][0] == "i":
                            after = tokens[k + 2][1] if k + 2 < n else ""
                            if after not in ("from", ",", "=") and inside in ("top", "namespace"):
                                raise Fault(f"import without from at line {line}")
                    elif text in ("new", "typeof", "delete", "void", "throw", "instanceof", "extends"):
                        if not nxt or nxt in ")]};," and text not in ("delete", "void"):
                            raise Fault(f"{text} without an operand at line {line}")
            plain = kind == "i" and value
            if kind == "i" and (text in _JS_VALUES or pt in (".", "?.")):
                plain = True
            head_close = False
        else:
            if text in ("(", "[", "{"):
                what = text
                if text == "(":
                    if pending == "function":
                        what, pending = "params", ""
                    elif pending == "head":
                        what, pending = "head", ""
                    elif pk == "i" and ppt == "@":
                        what = "head"
                    if what != "params" and pk == "d":
                        raise Fault(f"call of a number at line {line}")
                elif text == "{":
                    if pk in ("d", "s") and pending not in ("namespace", "class"):
                        raise Fault(f"{{ after a literal at line {line}")
                    if pending in ("class", "namespace", "object", "try", "finally"):
                        what, pending = pending, ""
                        what = "block" if what == "finally" else what
                    elif pk == "p" and pt in ("=", "(", ",", "[", "?", "||", "&&", "??", "...", "+") or pt == "return" or pt in (":", "default") and inside == "object" or pt == ":" and not ts and tern >= 0 and inside != "top" and not cases:
                        what = "object" if not ts or pt != "," or inside != "class" else "type"
                    elif ts and pk == "p" and pt in (":", "|", "&", "<", ">") or pt in ("import", "export", "type"):
                        what = "type"
                    else:
                        what = "block"
                if text in "([" and pk == "p" and pt == "." and text == "(":
                    raise Fault(f"( after a dot at line {line}")
                stack.append([text, what, tern, cases])
                tern = cases = 0
                plain = head_close = False
            elif text in (")", "]", "}"):
                if not stack or stack[-1][0] != _CLOSERS[text]:
                    raise Fault(f"unbalanced {text} at line {line}")
                if pk == "p" and pt not in ("(", "[", "{", ")", "]", "}", "++", "--", ",", ";") and not (pt == ":" and stack[-1][1] == "block") and not (ts and pt in (">", "?", "!", ">>", ">>>")) and not (pt == "*" and text == "}"):
                    raise Fault(f"{text} after {pt} at line {line}")
                if pt == "," and pk == "p" and ppt in ("(", "{"):
                    raise Fault(f"empty item at line {line}")
                if pk == "p" and pt == ";" and text == "]" or pk == "p" and pt == ";" and text == ")" and stack[-1][1] != "head":
                    raise Fault(f"{text} after ; at line {line}")
                opener, what, tern, cases = stack.pop()
                head_close = what == "head"
                if what == "try":
                    awaiting = "catch"
                elif what == "params":
                    awaiting = "body"
                    if not ts and nxt == ":":
                        raise Fault(f"type annotation at line {line}")
                plain = False
            elif text == ":":
                if not ts:
                    if tern:
                        tern -= 1
                    elif cases:
                        cases -= 1
                    elif inside == "object" or inside in ("block", "top") and pk == "i" and ppt in (";", "{", "}", ")", ":", ""):
                        pass
                    else:
                        raise Fault(f"type annotation at line {line}")
                elif pk == "p" and pt in _JS_BINARY and pt not in (">", "?", ":", "|"):
                    raise Fault(f": after {pt} at line {line}")
                plain = head_close = False
            else:
                if pk == "p" and pt in (".", "?.") and not (pt == "?." and text in "(["):
                    raise Fault(f"{text} after a dot at line {line}")
                if text == "?":
                    tern += 1
                if text in (";", ","):
                    if pk == "p" and pt not in (")", "]", "}", "++", "--", ";", "{") and not (ts and pt in (">", "?", "!", ">>", ">>>")) and not (text == ";" and pt == ":") and not (text == "," and pt in ("[", ",") and inside == "[") and not (text == ";" and pt == "("):
                        raise Fault(f"{text} after {pt} at line {line}")
                    if text == "," and pk == "p" and pt in ("{", ";"):
                        raise Fault(f", after {pt} at line {line}")
                elif text in _JS_BINARY and (pk == "p" or not pk):
                    if pt in ("(", "[", ",", ";", "{", "") and text not in ("*",) and not (ts and text in ("|", "&", "?", ":", "=>")) and not (ts and text == ">" and pt == ","):
                        if not (text == "=" and pt == "("):
                            raise Fault(f"{text} after {pt or 'the start'} at line {line}")
                    elif pt == "" and text == "*":
                        raise Fault(f"* at the start, line {line}")
                    elif pt not in (")", "]", "}", "(", "[", ",", ";", "{", "++", "--") and not (pt in (">", ">>", ">>>", "?", "!") and ts) and not (ts and text in ("|", "&", "?")) and not (text == "?" or pt == "*" and text == "="):
                        raise Fault(f"{text} after {pt} at line {line}")
                elif text in ("<", "++", "--", "!") and text == "<" and not ts and (pk == "p" and pt in ("(", "[", ",", ";", "{", "=", "") or not pk):
                    raise Fault(f"< without an operand at line {line}")
                elif ts and text == "<" and not pk:
                    raise Fault("markup at the start")
                plain = head_close = False
        ppt, pk, pt, pline = pt, kind, text, line
    if stack:
        raise Fault(f"premature end: {stack[-1][0]} is not closed")
    if awaiting == "catch" or awaiting == "body" and not ts:
        raise Fault("premature end of a statement")
    if pk == "p" and pt not in (")", "]", "}", ";", "++", "--") and not (ts and pt in (">", "!")):
        raise Fault(f"premature end after {pt}")
    if pending:
        raise Fault(f"premature end in a {pending}")
    if pk == "i" and not plain and pt in _JS_KEYWORDS - {"break", "continue", "return", "debugger", "async", "of", "get", "set", "as", "from", "static", "let", "yield", "await"}:
        raise Fault(f"premature end after {pt}")


def _check_java(lx: Lexed) -> None:
    tokens, n = lx.tokens, len(lx.tokens)
    stack: list[list] = []
    pending, pk, pt, ppt, pline, run, marked = "", "", "", "", 0, 0, False
    opened = -1  # the opener of the bracket closed last
    for k in range(n):
        kind, text, _, line = tokens[k]
        nxt = tokens[k + 1][1] if k + 1 < n else ""
        inside = stack[-1][1] if stack else "top"
        starts = pk == "" or pk == "p" and pt in (";", "}", "{")
        if kind in "ids":
            word = kind == "i" and text in _JAVA_KEYWORDS
            if inside == "top" and starts and not (kind == "i" and text in _JAVA_TOP):
                raise Fault(f"{text[:20]} cannot start a declaration at line {line}")
            if inside == "class" and starts and (text in ("if", "for", "while", "return", "switch", "try", "throw", "do", "else", "import", "package") or kind != "i"):
                raise Fault(f"{text[:20]} in a class body at line {line}")
            if inside == "block" and starts and text in ("private", "protected", "public", "import", "package"):
                raise Fault(f"{text} inside a block at line {line}")
            if pk in ("d", "s") and (kind != "i" or text != "instanceof"):
                raise Fault(f"operand after operand at line {line}")
            if pk == "i" and kind != "i" and pt not in _JAVA_KEYWORDS:
                raise Fault(f"operand after operand at line {line}")
            if kind == "i" and not word:
                run = run + 1 if pk == "i" and (pt not in _JAVA_KEYWORDS) and not marked else 1
                if run > 2:
                    raise Fault(f"three names in a row at line {line}")
            else:
                run = 0
            if word and text in _JAVA_STATEMENT and pk == "i" and pt not in _JAVA_KEYWORDS and not marked and pt != "default":
                raise Fault(f"{text} after {pt} at line {line}")
            if pt == ")" and pk == "p" and line != pline and not marked and not (kind == "i" and text in ("throws", "instanceof", "default")):
                raise Fault(f"statement without an end before line {line}")
            if pt == "]" and kind == "d" or pt == "." and kind != "i":
                raise Fault(f"{text[:20]} after {pt} at line {line}")
            if word and pt not in (".", "::"):
                if text in ("if", "while", "for", "switch", "catch", "synchronized") and nxt != "(" and not (text == "synchronized" and tokens[k + 1][0] == "i" if k + 1 < n else False):
                    raise Fault(f"{text} without a head at line {line}")
                if text in ("try",) and nxt not in ("{", "(") or text == "finally" and nxt != "{":
                    raise Fault(f"{text} without a block at line {line}")
                if text in ("class", "interface", "enum") and (k + 1 >= n or tokens[k + 1][0] != "i"):
                    raise Fault(f"{text} without a name at line {line}")
                if text in ("class", "interface", "enum") and nxt:
                    pending = "class"
                if text in ("if", "while", "for", "switch", "catch", "synchronized", "try"):
                    pending = "head" if nxt == "(" else "try"
                if text in ("new", "throw", "package", "import", "case", "instanceof", "extends", "implements", "throws", "else", "do") and (not nxt or nxt in ");,]}"):
                    raise Fault(f"{text} without an operand at line {line}")
            if text == "record" and k + 2 < n and tokens[k + 1][0] == "i" and tokens[k + 2][1] in ("(", "<") and (starts or pt in ("public", "private", "static", "final")):
                pending = "record"
            marked = pt == "@" or pt == "." and marked
        else:
            if text in "([{":
                what = text
                if text == "(":
                    if pending == "head":
                        what, pending = "head", ""
                    elif marked:
                        what = "mark"
                elif text == "{":
                    if pending in ("class", "record"):
                        what, pending = "class", ""
                    elif pending == "try":
                        what, pending = "block", ""
                    elif pt in ("=", ",", "]", "(") or pt == "{" and inside == "array":
                        what = "array"
                    elif pt == ")" and pk == "p" and inside in ("block", "array", "(", "head", "lambda") and _is_new(tokens, opened):
                        what = "class"
                    else:
                        what = "block"
                    if inside == "top" and what != "class":
                        raise Fault(f"block outside a class at line {line}")
                    if pk in ("d", "s"):
                        raise Fault(f"{{ after a literal at line {line}")
                if pk == "d" and text == "(" or pk == "p" and pt == "." and text in "([{":
                    raise Fault(f"{text} after {pt} at line {line}")
                stack.append([text, what, k])
                run, marked = 0, False
            elif text in ")]}":
                if not stack or stack[-1][0] != _CLOSERS[text]:
                    raise Fault(f"unbalanced {text} at line {line}")
                if pk == "p" and pt not in ("(", "[", "{", ")", "]", "}", "++", "--", ",", ";", ">", "...") and not (pt == ":" and text == "}") and not (pt == "->"):
                    raise Fault(f"{text} after {pt} at line {line}")
                if pk == "p" and pt == "," and text in ")]":
                    raise Fault(f"{text} after , at line {line}")
                if pk == "p" and pt == ";" and text in ")]" and stack[-1][1] != "head":
                    raise Fault(f"{text} after ; at line {line}")
                _, what, opened = stack.pop()
                if text == "}" and what == "block" and not (pk == "p" and pt in (";", "}", "{", ":")):
                    raise Fault(f"statement without an end at line {line}")
                run, marked = 0, what in ("head", "mark")
            else:
                if pk == "p" and pt == "." and not (text == "*" or text == "<"):
                    raise Fault(f"{text} after a dot at line {line}")
                if text in (";", ","):
                    if pk == "p" and pt not in (")", "]", "}", "++", "--", ";", "{", ">", ":", "->") and not (pt == "*" and ppt == ".") and not (text == ";" and pt == "(") and not (text == "," and pt in ("?",)) and not (text == ";" and pt == ","):
                        raise Fault(f"{text} after {pt} at line {line}")
                    if text == "," and pk == "p" and pt in ("{", ";"):
                        raise Fault(f", after {pt} at line {line}")
                elif text in ("*", "/", "%", "=", "==", "!=", "<=", ">=", "&&", "||", "&", "|", "^", "<<", "+=", "-=", "*=", "/=", "%=", "->", "::", ".", "?", ":"):
                    if (pk == "p" or not pk) and pt not in (")", "]", "}", "++", "--", ">") and not (text == "?" and pt in ("<", ",")) and not (text in (".", "::") and pt == ">") and not (text == "*" and pt == "."):
                        raise Fault(f"{text} after {pt or 'the start'} at line {line}")
                if text == "@" and nxt == "interface":
                    pending = "class"
                run, marked = 0, False
        ppt, pk, pt, pline = pt, kind, text, line
    if stack:
        raise Fault(f"premature end: {stack[-1][0]} is not closed")
    if pk and not (pk == "p" and pt in (";", "}")):
        raise Fault("premature end of a declaration")


def _is_new(tokens, opened: int) -> bool:
    """Whether the parenthesis at ``opened`` belongs to ``new Type(...)``."""
    j = opened - 1
    while j >= 0 and (tokens[j][0] == "i" and tokens[j][1] != "new" or tokens[j][1] in (".", ">", "<", ",", "?")):
        j -= 1
    return j >= 0 and tokens[j][1] == "new"


def _check_rust(lx: Lexed) -> None:
    tokens, n = lx.tokens, len(lx.tokens)
    stack: list[list] = []
    pending, pk, pt, ppt, marked, lets = "", "", "", "", False, 0
    for k in range(n):
        kind, text, _, line = tokens[k]
        nxt = tokens[k + 1][1] if k + 1 < n else ""
        inside = stack[-1][1] if stack else "top"
        if inside == "macro" and text not in "([{)]}":
            ppt, pk, pt = pt, kind, text
            continue
        if kind in "ids":
            life = kind == "s" and text[0] == "'" and text[-1] != "'"
            value = kind != "i" or text not in _RUST_KEYWORDS
            starts = pk == "" or pk == "p" and pt in (";", "}") or marked and pt == "]"
            if inside == "top" and starts and not (kind == "i" and (text in _RUST_TOP or nxt in ("!", "::"))):
                raise Fault(f"{text[:20]} cannot start an item at line {line}")
            if not life and not (pk == "s" and pt[0] == "'" and pt[-1] != "'"):
                if pk in ("d", "s") and (value or text in _RUST_STATEMENT):
                    raise Fault(f"operand after operand at line {line}")
                if pk == "i" and pt not in _RUST_KEYWORDS and (value or text in _RUST_STATEMENT):
                    raise Fault(f"operand after operand at line {line}")
                if pk == "p" and pt in (")", "]") and (value or text in _RUST_STATEMENT - {"pub"}) and not marked:
                    raise Fault(f"operand after {pt} at line {line}")
            if pt == "." and pk == "p" and kind == "s":
                raise Fault(f"{text[:20]} after a dot at line {line}")
            if kind == "i" and not value:
                if text in ("fn", "struct", "enum", "trait", "mod", "type") and not (k + 1 < n and tokens[k + 1][0] == "i") and not (text == "fn" and nxt == "("):
                    raise Fault(f"{text} without a name at line {line}")
                if text == "fn":
                    pending = "fn"
                elif text in ("struct", "enum", "union"):
                    pending = "fields"
                elif text in ("impl", "trait", "mod"):
                    pending = "items"
                elif text == "let":
                    if not nxt or nxt in ("=", ";", ")", "}", ":"):
                        raise Fault(f"let without a pattern at line {line}")
                    if pt not in ("if", "while", "&&", "||", "("):
                        lets += 1
                elif text in ("use", "impl", "for", "in", "match", "while", "if", "as", "pub", "const", "static", "extern") and (not nxt or nxt in ");]}"):
                    raise Fault(f"{text} without an operand at line {line}")
            if pending == "fn" and pk == "i" and pt == "fn" and nxt not in ("(", "<"):
                raise Fault(f"function without parameters at line {line}")
            marked = text == "pub" or life and marked
        else:
            if text in "([{":
                what = text
                if pt == "!" and pk == "p" and ppt not in ("=", "(", ",", "&&", "||", "{", ";", "!", "return") or pt == "macro_rules" or ppt == "macro_rules" or inside == "macro":
                    what = "macro"
                elif text == "[" and pk == "p" and (pt == "#" or pt == "!" and ppt == "#"):
                    what = "attribute"
                elif text == "(" and pk == "i" and pt == "pub":
                    what = "attribute"
                elif text == "{":
                    if pending in ("items", "fields"):
                        what, pending = pending, ""
                    elif pending == "fn":
                        what, pending = "block", ""
                    else:
                        what = "block"
                    if inside == "top" and what == "block" and (pk == "" or pk == "p" and pt in (";", "}")):
                        raise Fault(f"{{ after {pt} at line {line}")
                if pk == "p" and pt == "." or pk == "d" and text == "(":
                    raise Fault(f"{text} after {pt} at line {line}")
                if what == "macro" and text == "{" or ppt == "macro_rules":
                    what = "macro"
                stack.append([text, what, lets])
                lets, marked = 0, False
            elif text in ")]}":
                if not stack or stack[-1][0] != _CLOSERS[text]:
                    raise Fault(f"unbalanced {text} at line {line}")
                if stack[-1][1] != "macro":
                    if pk == "p" and pt not in ("(", "[", "{", ")", "]", "}", ",", ";", ">", "?", "..", "*", "|", "||", ">>") or pk == "p" and pt in ("*", "|") and ppt not in ("::", "(", ",", "|", "]", ")") and text != "}":
                        raise Fault(f"{text} after {pt} at line {line}")
                    if pk == "p" and pt == "," and ppt in ("(", "{", "["):
                        raise Fault(f"empty item at line {line}")
                    if lets > 0 and text == "}":
                        raise Fault(f"let without an end at line {line}")
                    if pk == "p" and pt == ";" and text == ")":
                        raise Fault(f") after ; at line {line}")
                what = stack[-1][1]
                lets = stack.pop()[2]
                marked = what == "attribute"
            else:
                if pk == "p" and pt == ".":
                    raise Fault(f"{text} after a dot at line {line}")
                if text == ";":
                    lets = max(0, lets - 1)
                    pending = "" if pending in ("fn", "fields", "items") else pending
                if text in (";", ","):
                    if pk == "p" and pt not in (")", "]", "}", ";", ">", "?", "..", "{", ">>", "*", "_") and not (text == "," and pt in ("|",)) and not (pt == "*" and ppt == "::"):
                        raise Fault(f"{text} after {pt} at line {line}")
                    if text == "," and pk == "p" and pt in ("{", ";") or text == "," and pk == "p" and pt == "," or text == "," and pk == "p" and pt == "*" and ppt != "::":
                        raise Fault(f", after {pt} at line {line}")
                elif text in ("/", "%", "=", "==", "!=", "<=", ">=", "^", "+=", "-=", "*=", "/=", "%=", "->", "=>", ".", "?", ":", "+"):
                    if (pk == "p" or not pk) and pt not in (")", "]", "}", ">", "?", ">>", "|", "||", "..") and not (text == "=" and pt == ",") and not (text == "=>" and pt in ("_",)):
                        raise Fault(f"{text} after {pt or 'the start'} at line {line}")
                if inside == "top" and (pk == "" or pk == "p" and pt in (";", "}")) and text not in ("#", ";", "::", "<"):
                    raise Fault(f"{text} cannot start an item at line {line}")
                marked = False
        ppt, pk, pt = pt, kind, text
    if stack:
        raise Fault(f"premature end: {stack[-1][0]} is not closed")
    if pk and not (pk == "p" and pt in (";", "}", ")", "]")) or pending == "fn":
        raise Fault("premature end of an item")


def _check_go(lx: Lexed) -> None:
    tokens, n = lx.tokens, len(lx.tokens)
    stack: list[list] = []
    pk, pt, ppt, pline, run, funcs = "", "", "", 0, 0, 0
    if n and tokens[0][1] != "package":
        raise Fault("no package clause")
    for k in range(n):
        kind, text, _, line = tokens[k]
        nxt = tokens[k + 1][1] if k + 1 < n else ""
        inside = stack[-1][1] if stack else "top"
        newline = line != pline and pk != ""
        ended = newline and (pk in ("d", "s") or pk == "i" and (pt not in _GO_KEYWORDS or pt in ("break", "continue", "fallthrough", "return")) or pk == "p" and pt in (")", "]", "}", "++", "--"))
        if ended and inside in ("(", "[", "value") and not (text == "." and False):
            raise Fault(f"line ends inside {stack[-1][0]} at line {pline}")
        starts = k == 0 or ended or pk == "p" and pt == ";"
        if kind in "ids":
            word = kind == "i" and text in _GO_KEYWORDS
            if inside == "top" and k and starts and text not in _GO_TOP:
                raise Fault(f"{text[:20]} cannot start a declaration at line {line}")
            if inside == "block" and starts and text in ("import", "package"):
                raise Fault(f"{text} inside a block at line {line}")
            if text == "func" and starts and inside == "block" and nxt != "(":
                raise Fault(f"named function inside a block at line {line}")
            if not ended:
                if pk in ("d", "s"):
                    raise Fault(f"operand after operand at line {line}")
                if pk == "i" and pt not in _GO_KEYWORDS and (kind == "d" or kind == "s" and inside not in ("group", "type") or word and text not in ("func", "map", "chan", "struct", "interface", "range", "else")):
                    raise Fault(f"operand after operand at line {line}")
                run = run + 1 if kind == "i" and not word and pk == "i" and pt not in _GO_KEYWORDS else 1
                if run > 2:
                    raise Fault(f"three names in a row at line {line}")
                if pk == "p" and pt == ")" and kind != "i" or pk == "p" and pt == "." and kind != "i":
                    raise Fault(f"{text[:20]} after {pt} at line {line}")
            else:
                run = 1
            if word:
                if text in ("package", "import", "func", "var", "const", "type", "go", "defer", "map", "chan", "range", "goto") and not nxt or text == "package" and (k + 1 >= n or tokens[k + 1][0] != "i"):
                    raise Fault(f"{text} without a name at line {line}")
                if text == "func" and inside == "top" and starts:
                    j = k + 1
                    if nxt == "(":
                        depth = 0
                        while j < n:
                            depth += (tokens[j][1] == "(") - (tokens[j][1] == ")")
                            j += 1
                            if not depth:
                                break
                    if j >= n or tokens[j][0] != "i" or j + 1 >= n or tokens[j + 1][1] not in ("(", "["):
                        raise Fault(f"function without a name at line {line}")
                if text in ("if", "switch", "for", "select", "struct", "interface", "else") and (not nxt or nxt in ")];,"):
                    raise Fault(f"{text} without a body at line {line}")
                if text == "else" and newline:
                    raise Fault(f"else on a new line at line {line}")
        else:
            if text in "([{":
                what = text
                if text == "(":
                    what = "group" if pk == "i" and pt in ("import", "const", "var", "type") else "("
                elif text == "{":
                    if newline and (ended and pk == "p" and pt == ")" or inside == "top"):
                        raise Fault(f"{{ on a new line at line {line}")
                    if pk == "i" and pt in ("struct", "interface"):
                        what = "type"
                    elif pk == "i" and pt not in _GO_KEYWORDS and (ppt in ("=", ":=", "return", "&", "]", "(", ",", ":", "{") or ppt == "." and inside != "top") and not _go_head(tokens, k) or pk == "p" and pt in ("{", ",", ":"):
                        what = "value"
                    elif pk == "p" and pt == "}" and not ended:
                        what = "value"
                    else:
                        what = "block"
                    if pk in ("d", "s") and not _go_head(tokens, k):
                        raise Fault(f"{{ after a literal at line {line}")
                if pk == "p" and pt == "." and text == "{":
                    raise Fault(f"{text} after {pt} at line {line}")
                stack.append([text, what])
            elif text in ")]}":
                if not stack or stack[-1][0] != _CLOSERS[text]:
                    raise Fault(f"unbalanced {text} at line {line}")
                if pk == "p" and pt not in ("(", "[", "{", ")", "]", "}", ",", ";", "++", "--", "...") and not (pt == ":" and text in "]}"):
                    raise Fault(f"{text} after {pt} at line {line}")
                if pk == "p" and pt == "," and (ppt in ("(", "{", "[") or stack[-1][1] == "block"):
                    raise Fault(f"empty item at line {line}")
                stack.pop()
            else:
                if inside == "top" and starts and k and text not in (";",):
                    raise Fault(f"{text} cannot start a declaration at line {line}")
                if pk == "p" and pt == "." and text != "(":
                    raise Fault(f"{text} after a dot at line {line}")
                if ended and inside == "block" and text in ("/", "%", "=", "==", "!=", "<=", ">=", "&&", "||", "+=", "-=", ":=", "<", ">", "|", ",", ".", ":", "+"):
                    raise Fault(f"{text} at the start of line {line}")
                if text in (";", ","):
                    if pk == "p" and pt not in (")", "]", "}", "++", "--", ";", "{") and not (pt == ":"):
                        raise Fault(f"{text} after {pt} at line {line}")
                    if text == "," and pk == "p" and pt in ("{", ";", ","):
                        raise Fault(f", after {pt} at line {line}")
                elif text in ("/", "%", "=", "==", "!=", "<=", ">=", "&&", "||", "|", "<<", ">>", "+=", "-=", "*=", "/=", ":=", "<", ">"):
                    if pk == "p" and pt not in (")", "]", "}", "++", "--"):
                        raise Fault(f"{text} after {pt} at line {line}")
            run = 0
        ppt, pk, pt, pline = pt, kind, text, line
    if stack:
        raise Fault(f"premature end: {stack[-1][0]} is not closed")
    if pk == "p" and pt not in (")", "]", "}", ";", "++", "--") or pk == "i" and pt in _GO_KEYWORDS:
        raise Fault(f"premature end after {pt}")


def _go_head(tokens, k: int) -> bool:
    """Whether the brace at ``k`` opens the body of an if, for, switch or select statement of its line."""
    line, j = tokens[k][3], k - 1
    while j >= 0 and tokens[j][3] == line:
        if tokens[j][0] == "i" and tokens[j][1] in ("if", "for", "switch", "select", "func"):
            return tokens[j][1] != "func"
        j -= 1
    return False


def _check_python(lx: Lexed, text: str) -> None:
    _balance(lx.tokens)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text.removeprefix("\ufeff"), "file", "exec", ast.PyCF_ONLY_AST | 0x400000, dont_inherit=True)
    except (SyntaxError, ValueError) as e:
        raise Fault(f"{getattr(e, 'msg', e)} at line {getattr(e, 'lineno', 0)}") from None
    except (RecursionError, MemoryError):
        pass  # nested beyond the interpreter's stack; the lexer found it balanced


def syntax_fault(lang: str | None, text: str | None, lexed: Lexed | None = None) -> str | None:
    """What is wrong with a file, or None if it is valid. Null and blank content is valid, and so is every language without a lexer."""
    if lang is None or not text or text.isspace():
        return None
    lx = lexed or lex(lang, text)
    if lx.fault:
        return lx.fault
    try:
        if lang == "py":
            _check_python(lx, text)
        elif lang == "java":
            _check_java(lx)
        elif lang == "rs":
            _check_rust(lx)
        elif lang == "go":
            _check_go(lx)
        else:
            _check_script(lx, lang == "ts")
    except Fault as e:
        return str(e)
    return None


def fault_kind(fault: str) -> str:
    """Class of a fault: ``merge marker``, ``unterminated``, ``unbalanced``, ``premature end`` or ``grammar``."""
    for word, kind in (("merge-conflict", "merge marker"), ("unterminated", "unterminated"), ("unbalanced", "unbalanced"), ("never closed", "premature end"), ("premature", "premature end")):
        if word in fault:
            return kind
    return "grammar"


def syntax_faults(files: DataFrame) -> DataFrame:
    """file_id, prefix, lang, fault of every file, ``fault`` null if it is valid; rows of the same file_id are one row.

    ``lang`` is the language of the path's extension, whatever the column of that name says. Null content and unknown
    extensions are valid. Files are read whole. Extra columns are ignored; an empty table gives no rows.
    """
    import pandas as pd

    ship(files.sparkSession)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs = [language_of(p) for p in b["path"]]
            yield pd.DataFrame({"file_id": b["file_id"], "prefix": b["prefix"], "lang": langs, "fault": [syntax_fault(g, c) for g, c in zip(langs, b["content"], strict=True)]})

    rows = files.where("file_id is not null").select("file_id", "prefix", "path", "content")
    return rows.mapInPandas(check, "file_id long, prefix string, lang string, fault string").dropDuplicates(["file_id"])


def broken_files(files: DataFrame) -> DataFrame:
    """file_id of every file that is not valid in the language of its extension."""
    return syntax_faults(files).where("fault is not null").select("file_id")


def fault_rates(files: DataFrame) -> DataFrame:
    """prefix, lang, n_files, n_broken, rate: per repository and language, files without a known language under null."""
    return syntax_faults(files).groupBy("prefix", "lang").agg(F.count("*").alias("n_files"), F.count("fault").alias("n_broken"), F.round(F.count("fault") / F.count("*"), 6).alias("rate"))
