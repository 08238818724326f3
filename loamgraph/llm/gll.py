"""Generalised LL parsing of function declarations in a token stream, with a graph-structured stack and error recovery.

Grammars are island grammars: they describe declarations and skip everything else. A grammar maps a nonterminal to
alternatives, each a tuple of symbols. A symbol is a nonterminal's name or a terminal of :data:`TERMINALS`. All alternatives
are followed at once: a descriptor is a grammar slot with a stack node and a position, a stack node stands for
a nonterminal begun at a position and is shared by all that call it there, and its results are handed to callers that
come later. So left recursion and ambiguity cost no backtracking. Recovery: where no alternative matches the parser takes up the next
position that can begin a declaration; brackets are matched beforehand, and one that has no partner in a broken file
ends at the next token that only a new declaration can start with.
"""

from __future__ import annotations

from typing import NamedTuple

from loamgraph.llm.lexing import Lexed

_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = {v: k for k, v in _OPEN.items()}

# Words of each language that are no names of functions.
RESERVED = {
    "js": set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield await".split()),
    "java": set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split()),
    "py": set("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()),
    "rs": set("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while".split()),
    "go": set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
}
RESERVED["ts"] = RESERVED["js"]

# Grammars by language; "Function" is what is sought.
GRAMMARS: dict[str, dict[str, list[tuple[str, ...]]]] = {
    "py": {"Function": [("'def", "NAME", "TypeParams", "PARENS", "Returns", "':")], "TypeParams": [(), ("BRACKETS",)], "Returns": [(), ("'->", "Type")], "Type": [("ITEM",), ("Type", "ITEM")]},
    "go": {"Function": [("'func", "Receiver", "NAME", "TypeParams", "PARENS")], "Receiver": [(), ("PARENS",)], "TypeParams": [(), ("BRACKETS",)]},
    "rs": {"Function": [("'fn", "NAME", "TypeParams", "PARENS")], "TypeParams": [(), ("ANGLES",)]},
    "java": {
        "Function": [("NAME", "PARENS", "Dims", "Throws", "Body"), ("MEMBER", "PARENS", "Throws", "BRACES")],
        "Dims": [(), ("BRACKETS", "Dims")],
        "Throws": [(), ("'throws", "Types")],
        "Types": [("Type",), ("Types", "',", "Type")],
        "Type": [("WORD",), ("Type", "'.", "WORD"), ("Type", "ANGLES")],
        "Body": [("BRACES",), ("';",), ("'default",)],
    },
    "js": {
        "Function": [
            ("'function", "Star", "NAME", "TypeParams", "PARENS"),
            ("NAME", "Annotation", "'=", "Async", "Value"),
            ("NAME", "':", "Async", "Value"),
            ("MEMBER", "TypeParams", "PARENS", "Annotation", "BRACES"),
        ],
        "Star": [(), ("'*",)],
        "Async": [(), ("'async",)],
        "TypeParams": [(), ("ANGLES",)],
        "Annotation": [(), ("':", "Type")],
        "Type": [("TYPE",), ("Type", "TYPE")],
        "Value": [("TypeParams", "PARENS", "Annotation", "'=>"), ("WORD", "'=>"), ("'function", "Star", "Inner", "PARENS")],
        "Inner": [(), ("WORD",)],
    },
}
GRAMMARS["ts"] = GRAMMARS["js"]

# Tokens that a terminal can begin with; None: any token, "": any word.
_BEGINS = {"PARENS": {"("}, "BRACES": {"{"}, "BRACKETS": {"["}, "ANGLES": {"<"}, "NAME": {""}, "MEMBER": {""}, "WORD": {""}, "ITEM": None, "TYPE": None}


def select_sets(grammar: dict[str, list[tuple[str, ...]]]) -> dict[str, list[list[frozenset[str] | None]]]:
    """Per rule, alternative and dot: the tokens with which the rest of the alternative can go on, None where that may be any token or nothing."""
    nullable: set[str] = set()
    first: dict[str, set | None] = {rule: set() for rule in grammar}

    def rest(body: tuple[str, ...]) -> set | None:
        out: set = set()
        for symbol in body:
            begins = first[symbol] if symbol in grammar else {symbol[1:]} if symbol[0] == "'" else _BEGINS[symbol]
            if begins is None:
                return None
            out |= begins
            if symbol not in nullable:
                return out
        return None  # nothing more may be needed

    changed = True
    while changed:
        changed = False
        for rule, alternatives in grammar.items():
            for body in alternatives:
                if rule not in nullable and all(x in nullable for x in body):
                    nullable.add(rule)
                    changed = True
                begins: set | None = set()
                for symbol in body:
                    own = first[symbol] if symbol in grammar else {symbol[1:]} if symbol[0] == "'" else _BEGINS[symbol]
                    begins = None if own is None or begins is None else begins | own
                    if symbol not in nullable or begins is None:
                        break
                new = None if begins is None or first[rule] is None else first[rule] | begins
                if new != first[rule]:
                    first[rule], changed = new, True
    return {rule: [[(lambda r: None if r is None else frozenset(r))(rest(body[k:])) for k in range(len(body) + 1)] for body in alternatives] for rule, alternatives in grammar.items()}


class Slots(NamedTuple):
    """A grammar as numbered slots: the one after a slot is the next dot of its alternative."""

    starts: dict[str, list[int]]  # first slots of the alternatives of each rule
    symbols: list[str | None]  # what stands after the dot; None at the end
    literals: list[str | None]  # its text, if it is a literal
    wanted: list[frozenset[str] | None]  # tokens with which the alternative can go on


def compiled(grammar: dict[str, list[tuple[str, ...]]]) -> Slots:
    out, select = Slots({}, [], [], []), select_sets(grammar)
    for rule, alternatives in grammar.items():
        out.starts[rule] = []
        for body, sets in zip(alternatives, select[rule], strict=True):
            out.starts[rule].append(len(out.symbols))
            out.symbols.extend([*body, None])
            out.literals.extend([x[1:] if x[0] == "'" else None for x in body] + [None])
            out.wanted.extend(sets)
    return out


_SLOTS: dict[str, Slots] = {}

_MEMBER_BEFORE = set("{ } ; , * async get set static public private protected readonly abstract override accessor declare".split())
_JAVA_NOT_TYPE = set("new return throw else do case assert instanceof".split())
# Words that begin a declaration at the start of a line, where recovery takes up.
_SYNC = {"def", "class", "function", "export", "import", "fn", "pub", "impl", "func", "type", "public", "private", "protected", "package", "use", "struct", "enum", "trait", "interface"}


class Island(NamedTuple):
    name: str
    line: int  # of the name
    token: int  # index of the name's token
    first: int  # index of the token that was taken up
    end: int  # index after the last token of the match


class Parser:
    def __init__(self, lang: str, lexed: Lexed):
        self.lang, self.tokens = lang, lexed.tokens
        self.grammar, self.reserved = GRAMMARS[lang], RESERVED[lang]
        if lang not in _SLOTS:
            _SLOTS[lang] = compiled(self.grammar)
        self.texts = [t[1] if t[0] != "i" else "" for t in self.tokens]
        self.partner = self._match_brackets()
        self._done: dict[tuple[str, int], set[tuple[int, int]]] = {}
        self._after_angle: dict[int, int] = {}  # by position of the "<"

    def _match_brackets(self) -> list[int]:
        partner, stack = [-1] * len(self.tokens), []
        for k, (kind, text, _, _) in enumerate(self.tokens):
            if kind != "p":
                continue
            if text in _OPEN:
                stack.append(k)
            elif text in _CLOSE:
                depth = len(stack) - 1
                while depth >= 0 and self.tokens[stack[depth]][1] != _CLOSE[text]:
                    depth -= 1
                if depth >= 0:  # openers above it have no partner
                    partner[stack[depth]], partner[k] = k, stack[depth]
                    del stack[depth:]
        return partner

    def _after_group(self, pos: int, opener: str) -> int:
        if self.tokens[pos][1] != opener or self.tokens[pos][0] != "p":
            return -1
        if self.partner[pos] >= 0:
            return self.partner[pos] + 1
        k, n, last = pos + 1, len(self.tokens), self.tokens[pos][3]
        while k < n and not (self.tokens[k][3] != last and self.tokens[k][1] in _SYNC):
            last = self.tokens[k][3]
            k += 1
        return k if opener == "{" else -1

    def _angles(self, pos: int) -> int:
        """Position after the ``>`` that closes the ``<`` at a position; ``;`` or a closing bracket ends a stray one. Scanned once per position."""
        if self.tokens[pos][:2] != ("p", "<"):
            return -1
        if pos not in self._after_angle:
            self._scan_angles(pos)
        return self._after_angle[pos]

    def _scan_angles(self, pos: int) -> None:
        open_at, k, n = [], pos, len(self.tokens)
        while k < n:
            text = self.tokens[k][1] if self.tokens[k][0] == "p" else ""
            if text in ("(", "[", "{") and self.partner[k] > 0:
                k = self.partner[k]
            elif text in (";", ")", "]", "}"):
                break
            elif text and set(text) <= {"<", ">"}:
                open_at += [k] * text.count("<")
                for _ in range(min(text.count(">"), len(open_at))):
                    self._after_angle[open_at.pop()] = k + 1
                if not open_at:
                    return
            k += 1
        for at in open_at:
            self._after_angle[at] = -1

    def terminal(self, symbol: str, pos: int) -> int:
        """Position after the terminal, -1 if it does not stand here."""
        if pos >= len(self.tokens):
            return -1
        kind, text, _, _ = self.tokens[pos]
        if symbol in ("NAME", "MEMBER", "WORD"):
            if kind != "i" or text in self.reserved:
                return -1
            before = self.tokens[pos - 1] if pos else ("", "", 0, 0)
            if symbol == "MEMBER" and self.lang == "java":  # a constructor without modifiers
                return pos + 1 if before[0] == "p" and before[1] in ("{", "}", ";") else -1
            if symbol == "MEMBER" and not (before[1] in _MEMBER_BEFORE or before[3] != self.tokens[pos][3] and before[1] not in (".", "=", "(", ",", "function")):
                return -1
            if symbol == "NAME" and self.lang == "java":  # a return type or a modifier stands before it
                typed = before[0] == "i" and before[1] not in _JAVA_NOT_TYPE or before[1] in (">", "]")
                return pos + 1 if typed else -1
            return pos + 1
        if symbol == "PARENS":
            return self._after_group(pos, "(")
        if symbol == "BRACES":
            return self._after_group(pos, "{")
        if symbol == "BRACKETS":
            return self._after_group(pos, "[")
        if symbol == "ANGLES":
            return self._angles(pos)
        if symbol == "ITEM":
            if text in ("(", "[", "{") and kind == "p":
                return self._after_group(pos, text)
            return pos + 1 if not (kind == "p" and text in (":", ")", "]", "}", ";", "=")) else -1
        if symbol == "TYPE":
            if kind == "p":
                if text in ("(", "[", "{"):
                    return self._after_group(pos, text)
                return self._angles(pos) if text == "<" else pos + 1 if text in (".", "|", "&", "=>", "?") else -1
            return pos + 1
        raise KeyError(symbol)

    def parse(self, start: str, pos: int) -> set[tuple[int, int]]:
        """All (end, name token) of the nonterminal at a position."""
        key0 = (start, pos)
        if key0 in self._done:
            return self._done[key0]
        starts, symbols, literals, wanted = _SLOTS[self.lang]
        tokens, texts, n = self.tokens, self.texts, len(self.tokens)
        callers: dict[tuple[str, int], set] = {key0: set()}  # the graph-structured stack: who waits for a node
        results: dict[tuple[str, int], set[tuple[int, int]]] = {key0: set()}
        todo: list[tuple] = []
        seen: set[tuple] = set()

        def put(slot: int, node: tuple[str, int], at: int, name: int) -> None:
            can = wanted[slot]  # the token at hand must let the slot go on
            if can is None or at < n and (texts[at] in can or not texts[at] and tokens[at][1] in can):
                d = (slot, node, at, name)
                if d not in seen:
                    seen.add(d)
                    todo.append(d)

        for slot in starts[start]:
            put(slot, key0, pos, -1)
        while todo:
            slot, node, at, name = todo.pop()
            symbol = symbols[slot]
            if symbol is None:
                if (at, name) not in results[node]:
                    results[node].add((at, name))
                    for back, above, m in callers[node]:
                        put(back, above, at, name if name >= 0 else m)
            elif literals[slot] is not None:
                if at < n and tokens[at][1] == literals[slot] and tokens[at][0] != "s":
                    put(slot + 1, node, at + 1, name)
            elif symbol in starts:
                child, back = (symbol, at), (slot + 1, node, name)
                if child not in callers:
                    callers[child], results[child] = set(), set()
                    for first in starts[symbol]:
                        put(first, child, at, -1)
                if back not in callers[child]:
                    callers[child].add(back)
                    for end, m in results[child]:
                        put(slot + 1, node, end, m if m >= 0 else name)
            else:
                end = self.terminal(symbol, at)
                if end >= 0:
                    put(slot + 1, node, end, at if symbol in ("NAME", "MEMBER") else name)
        self._done[key0] = results[key0]
        return results[key0]

    def _can_start(self, k: int) -> bool:
        kind, text, _, _ = self.tokens[k]
        if kind != "i":
            return False
        if self.lang == "py":
            return text == "def"
        if self.lang == "go":
            return text == "func"
        if self.lang == "rs":
            return text == "fn"
        if k + 1 >= len(self.tokens):
            return False
        after = self.tokens[k + 1][1]
        if self.lang == "java":
            return after == "(" and text not in self.reserved
        if text == "function":
            return True
        if text in self.reserved or after not in ("(", "=", ":", "<"):
            return False
        if after == "(":
            close = self.partner[k + 1]
            return close < 0 or close + 1 < len(self.tokens) and self.tokens[close + 1][1] in ("{", ":")
        return after != ":" or not (k and self.tokens[k - 1][1] in ("?", "case"))

    def functions(self) -> list[Island]:
        """Every declaration of the file, also those of a file that is broken elsewhere, by position."""
        found: dict[int, Island] = {}
        for k in range(len(self.tokens)):
            if self._can_start(k):
                for end, name in self.parse("Function", k):
                    if name >= 0 and (name not in found or end > found[name].end):
                        found[name] = Island(self.tokens[name][1], self.tokens[name][3], name, k, end)
        return [found[n] for n in sorted(found)]
