"""From source text to a graph: symbols with their spans, and raw edges that name what they mean.

Literals and comments are blanked first, so that brackets and words in them do not count; then declarations are found by their
heads and their ends by brackets or indentation. A file is one row, and files do not depend on each other. What a name means is
left to the set operations of ``resolve`` and ``proofs``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import ship

# Languages by file ending.
BY_ENDING = {"js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "js", "tsx": "js", "mts": "js", "cts": "js", "py": "py", "pyi": "py", "java": "java", "go": "go", "rs": "rs"}
# Words that stand before a bracket without being called.
_COMMON = "if for while switch return else case in new throw try catch match loop yield super".split()
NO_CALL = {
    "js": {*_COMMON, *"function async do of typeof await class instanceof delete void with".split()},
    "py": {*_COMMON, *"def class lambda not and or elif except with print assert await del from import is".split()},
    "java": {*_COMMON, *"do class synchronized instanceof this assert".split()},
    "go": {*_COMMON, *"func go defer select range map chan struct interface type".split()},
    "rs": {*_COMMON, *"fn let mut impl as unsafe move".split()},
}

_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_BLANK = {
    "js": re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|`(?:[^`\\]|\\[\s\S])*`|{_STRING}"),
    "java": re.compile(rf'//[^\n]*|/\*[\s\S]*?\*/|"""[\s\S]*?"""|{_STRING}'),
    "go": re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|{_STRING}"),
    "rs": re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|r(#*)"[\s\S]*?"\1|"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[^\n])\'|\'\\u\{[^}]*\}\''),
    "py": re.compile(rf"#[^\n]*|'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|{_STRING}"),
}
_NAME = r"[A-Za-z_$][\w$]*"
# Heads of declarations; the group that matched is the name.
_TYPES = {
    "js": re.compile(rf"\b(class|interface|enum)\s+({_NAME})(?:[^{{;()=]*?\bextends\s+({_NAME}))?(?:[^{{;()=]*?\bimplements\s+({_NAME}))?[^{{;()=]*(?=\{{)"),
    "java": re.compile(rf"\b(class|interface|enum|record)\s+({_NAME})(?:[^{{;]*?\bextends\s+({_NAME}))?(?:[^{{;]*?\bimplements\s+({_NAME}))?[^{{;]*(?=\{{)"),
    "go": re.compile(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*(?=\{)", re.M),
    "rs": re.compile(r"\b(struct|enum|trait|union)\s+(\w+)"),
    "py": re.compile(r"^([ \t]*)class\s+(\w+)[ \t]*(?:\(\s*([\w.]*))?", re.M),
}
_FUNCTIONS = {
    "js": re.compile(rf"\bfunction\s*\*?\s*({_NAME})\s*(?:<[^(){{}}]*>)?\s*(?=\()|\b(?:const|let|var)\s+({_NAME})\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:function\b[^(]*(?=\()|(?=\([^()]*\)\s*(?::[^={{;]+)?=>)|(?={_NAME}\s*=>))|(?:^|(?<=[{{}};]))[ \t]*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set|export|default)\s+|\*\s*)*(#?{_NAME})\s*(?:<[^(){{}}]*>)?(?=\()", re.M),
    "java": re.compile(r"(?<![\w.])(\w+)\s*(?=\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?[{;])"),
    "go": re.compile(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?(?=\()", re.M),
    "rs": re.compile(r"\bfn\s+(\w+)\s*(?:<[^(){}]*>)?\s*(?=\()"),
    "py": re.compile(r"^([ \t]*)(?:async\s+)?def\s+(\w+)\s*(?:\[[^\]]*\])?\s*(?=\()", re.M),
}
_CALL = re.compile(rf"(?:\b({_NAME})\s*(?:\.|::|\?\.)\s*)?\b({_NAME})\s*(?=\()")
_IMPORTS = {
    "js": re.compile(rf"""\b(?:import|export)\s+(?:type\s+)?((?:{_NAME}\s*,?\s*)?(?:\*\s*(?:as\s+{_NAME})?|\{{[^}}]*\}})?)\s*(?:from\s*)?["']([^"'\n]+)["']|\b(?:const|let|var)\s+({_NAME}|\{{[^}}]*\}})\s*=\s*require\(\s*["']([^"'\n]+)["']"""),
    "py": re.compile(r"^[ \t]*from\s+([.\w]+)\s+import\s+(\([^)]*\)|[^\n#]+)|^[ \t]*import\s+([^\n#]+)", re.M),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M),
    "go": re.compile(r'^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([^"\n]+)"\s*$', re.M),
    "rs": re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)(?:::\{([^}]*)\})?(?:\s+as\s+(\w+))?\s*;", re.M),
}


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return BY_ENDING.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def _brackets(text: str) -> dict[int, int]:
    """Partner of every opening bracket that has one."""
    partner, stack = {}, []
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m[0]
        if c in "([{":
            stack.append((c, m.start()))
        else:
            want = {")": "(", "]": "[", "}": "{"}[c]
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] != want:
                depth -= 1
            if depth >= 0:
                partner[stack[depth][1]] = m.start()
                del stack[depth:]
    return partner


def _arity(params: str, lang: str) -> tuple[int, bool]:
    """(number of parameters without the receiver, whether the last takes any number)."""
    depth, parts, last = 0, [""], ""
    for c in params:
        depth += (c in "([{<") - (c in ")]}" or c == ">" and last not in "=-")
        last = c
        if c == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    parts = [p.strip() for p in parts if p.strip()]
    own = [p for p in parts if not re.match(r"(?:self|cls)\b|&\s*(?:'\w+\s+)?(?:mut\s+)?self\b|mut\s+self\b|this\s*:|[*/]$", p)]
    return len(own), any(p.startswith(("...", "*")) or "..." in p for p in own)


def _bindings(lang: str, m: re.Match) -> Iterator[tuple[str, str | None, str]]:
    """(specifier, imported name, local name) of an import; the imported name is ``*`` for a module as a whole, null for what only runs."""
    if lang == "js":
        what, spec = (m[1], m[2]) if m[2] else (m[3], m[4])
        if m[2] and m[0].lstrip().startswith("export"):
            what = what.strip()
            if what.startswith("*"):
                alias = re.search(rf"as\s+({_NAME})", what)
                yield spec, "*", f"export {alias[1] if alias else '*'}"
            for part in re.findall(rf"({_NAME})(?:\s+as\s+({_NAME}))?", what) if what.startswith("{") else ():
                yield spec, part[0], f"export {part[1] or part[0]}"
            return
        inner = re.search(r"\{([^}]*)\}", what or "")
        for part in re.findall(rf"(?:type\s+)?({_NAME})(?:\s*(?:as\s+|:\s*)({_NAME}))?", inner[1]) if inner else ():
            yield spec, part[0], part[1] or part[0]
        whole = re.search(rf"\*\s*as\s+({_NAME})", what or "")
        if whole:
            yield spec, "*", whole[1]
        first = re.match(rf"\s*({_NAME})", what or "")
        if first:
            yield spec, "*" if m[4] else "default", first[1]
        if not (what or "").strip():
            yield spec, None, ""
    elif lang == "py":
        if m[1]:
            for part in re.findall(r"(\w+|\*)(?:\s+as\s+(\w+))?", m[2]):
                yield m[1], part[0], part[1] or part[0]
        else:
            for part in re.findall(r"([\w.]+)(?:\s+as\s+(\w+))?", m[3]):
                yield part[0], "*", part[1] or part[0].split(".")[0]
    elif lang == "java":
        yield m[1], "*" if m[1].endswith("*") else m[1].rsplit(".", 1)[-1], m[1].rsplit(".", 1)[-1]
    elif lang == "go":
        yield m[2], "*", m[1] or m[2].rsplit("/", 1)[-1]
    else:
        if m[2] is not None:
            for part in re.findall(r"(\w+)(?:\s+as\s+(\w+))?", m[2]):
                yield m[1], part[0], part[1] or part[0]
        else:
            name = m[1].rsplit("::", 1)[-1]
            yield m[1].rsplit("::", 1)[0] if "::" in m[1] else m[1], name, m[3] or name


def extract(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """(symbols, raw edges) of one file."""
    lang = language_of(path)
    if lang is None or not text:
        return [], []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    blank = _BLANK[lang].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    partner = _brackets(blank)
    symbols, edges = [], []

    def block_end(at: int) -> int:
        """Where the declaration that begins at a position ends."""
        if lang == "py":
            indent = at - starts[line(at) - 1]
            end, k = at, line(at)
            colon = re.compile(r"\S")
            open_until = max((partner.get(p, p) for p in range(at, min(len(blank), at + 1)) if p in partner), default=at)
            while k < len(starts):
                stop = starts[k + 1] if k + 1 < len(starts) else len(blank)
                m = colon.search(text, starts[k], stop)
                if m:
                    if m.start() - starts[k] <= indent and starts[k] > open_until and blank[m.start()] not in ")]}":
                        break
                    end = m.start()
                k += 1
            return end
        k = at
        while k < len(blank):
            c = blank[k]
            if c == "{":
                return partner.get(k, len(blank) - 1)
            if c == ";" or c == "\n" and lang in ("go",) and k > at and blank[at:k].count("(") == blank[at:k].count(")"):
                return k
            k = partner.get(k, k) + 1 if c in "([" else k + 1
        return len(blank) - 1

    for m in _TYPES[lang].finditer(blank):
        if lang == "py":
            kind, name, at, base, iface = "class", m[2], m.start() + len(m[1]), m[3], None
        elif lang == "go":
            kind, name, at, base, iface = m[2], m[1], m.start(), None, None
        else:
            kind, name, at = m[1], m[2], m.start()
            base, iface = (m[3], m[4]) if lang in ("js", "java") else (None, None)
        symbols.append({"name": name, "kind": kind, "at": at, "end": block_end(m.end() if lang != "py" else at), "arity": None, "variadic": None, "owner": None})
        for relation, to in (("extends", base), ("implements", iface)):
            if to:
                edges.append({"relation": relation, "at": at, "name": to.rsplit(".", 1)[-1], "recv": None, "spec": None, "imported": None, "argc": None})
    impls = [(m.start(), block_end(m.end()), m[1]) for m in re.finditer(r"\bimpl\b(?:<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)[^{;]*(?=\{)", blank)] if lang == "rs" else []
    heads = set()
    types = [s for s in symbols]
    for m in _FUNCTIONS[lang].finditer(blank):
        group = next(g for g in range(m.lastindex or 1, 0, -1) if m[g] is not None)
        name, at = m[group].lstrip("#"), m.start(group)
        if lang == "py":
            name, at = m[2], m.start() + len(m[1])
        elif lang == "go":
            name, at = m[2], m.start()
        if name in NO_CALL[lang]:
            continue
        open_at = blank.find("(", m.end() - 1 if blank[m.end() - 1 : m.end()] == "(" else m.end())
        close = partner.get(open_at, -1)
        inside = [s for s in types if s["at"] < at <= s["end"]]
        owner = max(inside, key=lambda s: s["at"])["name"] if inside else None
        if lang == "js" and group == 3:  # a method stands in a class and has a body
            after = re.compile(r"\s*(?::[^;{}=]*(?:\{[^}]*\}[^;{}=]*)?)?\{").match(blank, close + 1) if close > 0 else None
            if owner is None or after is None:
                continue
        if lang == "java":
            before = re.search(r"([\w>\]]+)\s*$", blank[max(0, at - 200) : at])
            if not (before and before[1] not in ("new", "return", "throw", "else", "case") or owner == name) or owner is None:
                continue
        if lang == "go":
            owner = m[1]
        elif lang == "rs":
            around = [i for i in impls if i[0] < at <= i[1]]
            owner = max(around)[2] if around else owner
        heads.add(m.start(group))
        params = blank[open_at + 1 : close] if 0 <= open_at < close and (lang != "js" or group != 2 or blank[m.end() : open_at].strip() in ("", "async")) else ""
        arity, variadic = _arity(params, lang)
        symbols.append({"name": name, "kind": "method" if owner else "function", "at": at, "end": block_end(close + 1 if close > 0 and lang != "py" else at), "arity": arity, "variadic": variadic, "owner": owner})

    def innermost(at: int) -> str | None:
        around = [s for s in symbols if s["at"] <= at <= s["end"]]
        return max(around, key=lambda s: s["at"])["name"] if around else None

    for m in _CALL.finditer(blank):
        if m.start(2) in heads or m[2] in NO_CALL[lang]:
            continue
        close = partner.get(blank.find("(", m.end()), -1)
        argc = _arity(text[blank.find("(", m.end()) + 1 : close], lang)[0] if close > 0 else None
        if re.search(r"\b(?:function\*?|def|fn|func|class|new)\s+$", blank[max(0, m.start() - 12) : m.start()]) and not blank[max(0, m.start() - 12) : m.start()].rstrip().endswith("new"):
            continue
        edges.append({"relation": "calls", "at": m.start(2), "name": m[2], "recv": m[1], "spec": None, "imported": None, "argc": argc})
    go_block = [(m.end(), partner.get(m.end() - 1, m.end())) for m in re.finditer(r"^import\s*\(", blank, re.M)] if lang == "go" else []
    for m in _IMPORTS[lang].finditer(text):
        word = re.compile(r"\S").search(text, m.start(), m.end())
        if word is None or blank[word.start()] != text[word.start()] and lang != "go":  # in a comment or a string
            continue
        if lang == "go" and not (text[word.start() :].startswith("import") or any(a <= m.start() <= b for a, b in go_block)):
            continue
        for spec, imported, local in _bindings(lang, m):
            edges.append({"relation": "imports", "at": word.start(), "name": local, "recv": None, "spec": spec, "imported": imported, "argc": None})
    public = {
        "js": lambda s: bool(re.search(r"\bexport\b[\w\s]*$", blank[max(0, s["at"] - 60) : s["at"]].rsplit("\n", 1)[-1])) or s["owner"] is not None and not s["name"].startswith("_"),
        "py": lambda s: not s["name"].startswith("_"),
        "go": lambda s: s["name"][:1].isupper(),
        "rs": lambda s: bool(re.search(r"\bpub\b[^;{}]*$", blank[max(0, s["at"] - 60) : s["at"]].rsplit("\n", 1)[-1])),
        "java": lambda s: bool(re.search(r"\bpublic\b[^;{}]*$", blank[max(0, s["at"] - 120) : s["at"]].rsplit("\n", 1)[-1])),
    }[lang]
    found = [{**s, "start_line": line(s["at"]), "end_line": line(s["end"]), "exported": public(s)} for s in sorted(symbols, key=lambda s: s["at"])]
    raw = [{**e, "line": line(e["at"]), "scope": innermost(e["at"])} for e in sorted(edges, key=lambda e: (e["at"], e["name"]))]
    return found, raw


SYMBOLS = "path string, id string, name string, kind string, start_line int, end_line int, owner string, arity int, variadic boolean, exported boolean"
RAW = "path string, ord int, relation string, line int, scope string, name string, recv string, spec string, imported string, argc int"


def _extracted(files: DataFrame, schema: str, part: int) -> DataFrame:
    import pandas as pd

    ship(files.sparkSession)
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                seen: dict[str, int] = {}
                for k, one in enumerate(extract(path, text)[part]):
                    if part == 0:
                        key = f"{path}#{one['owner'] + '.' if one['owner'] else ''}{one['name']}"
                        seen[key] = seen.get(key, 0) + 1
                        one["id"] = key if seen[key] == 1 else f"{key}~{seen[key]}"
                    rows.append({"path": path, "ord": k, **one})
            yield pd.DataFrame(rows, columns=columns).astype(object)

    rows = files.where("path is not null and content is not null").select("path", "content")
    return rows.mapInPandas(run, schema)


def extract_symbols(files: DataFrame) -> DataFrame:
    """path, id, name, kind, start_line (of the name), end_line, owner, arity, variadic, exported of every declaration of the files (path, content).

    Ids are ``path#Owner.name``; repeated ones are numbered ``~2``, ``~3``. Null content and unknown endings give no rows, nor does an empty table.
    """
    return _extracted(files, SYMBOLS, 0)


def extract_edges(files: DataFrame) -> DataFrame:
    """path, ord, relation (``calls``, ``imports``, ``extends``, ``implements``), line, scope (the innermost symbol around), name, recv (what a member is
    called on), spec and imported (of an import: where from and what, ``*`` for the whole; re-exports have ``export`` before the name), argc."""
    return _extracted(files, RAW, 1)
