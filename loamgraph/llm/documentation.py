"""Functions paired with their documentation.

A file is lexed once; the declarations come from the generalised LL parser, also where the file is broken; the comment
right above a declaration, its docstring or the summary of its node is cleaned of marks and tags and kept if it says more than the name.
Description templates that the corpus repeats are found by hash counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.keys import path_key
from loamgraph.llm.gll import Island, Parser
from loamgraph.llm.lexing import Lexed, language_of, lex
from loamgraph.llm.syntax import syntax_fault
from loamgraph.session import materialize, ship

# Modifiers that stand before a declaration, by language.
_MODIFIERS = {
    "js": set("export default async function * const let var static get set public private protected readonly abstract override declare accessor".split()),
    "py": {"async", "def"},
    "go": {"func"},
}
_MODIFIERS["ts"] = _MODIFIERS["js"]

# Placeholders, tool directives and licence notes.
_PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:(?:todo|fixme|xxx|tbd|hack)\b.*|(?:add|insert|write|put|fill in|needs?|missing|no|your|the)\s+(?:(?:a|the|some|your|proper|better)\s+)*(?:\w+\s+)?(?:doc(?:s|umentation|string)?|description|comment|summary)\b(?:\s+\w+){0,4}|"
    r"auto-?\s?generated\s+(?:method|function|constructor)?\s*(?:stub|body|code).*|(?:document|describe)\s+(?:me|this)\b.*|(?:description|documentation|docstring|summary|comment)\s+(?:goes|comes|to be|will be|pending|missing|here)\b.*|"
    r"lorem ipsum.*|same as (?:before|above)\W*|see (?:above|below)\W*|n/?a|none|null|placeholder.*|to be (?:done|documented|written|described)\b.*|not (?:yet )?documented.*|undocumented.*|self[- ]explanatory.*|nothing to see here.*|does what it says.*|\{@inheritdoc\}.*|inheritdoc)\W*$"
)
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:eslint\b|@ts-|prettier-ignore|istanbul\s+ignore|c8\s+ignore|v8\s+ignore|noqa\b|type:\s*ignore|pylint\s*:|pyright\s*:|mypy\s*:|ruff\s*:|flake8\s*:|isort\s*:|pragma\b|go:\w+|\+build\b|nolint\b|rustfmt[-:]|rustfmt::|clippy::|checkstyle\s*[:.]|"
    r"nosonar\b|noinspection\b|fmt:\s*(?:on|off|skip)|yapf\s*:|biome-ignore|tslint\s*:|jshint\b|jslint\b|jscs\s*:|@flow\b|@noflow|@jest-|@vitest-|webpack\w+\s*:|region\b|endregion\b|#?region\b|-\*-.*-\*-|vim\s*:|cspell\s*:|spell-?checker\s*:|codecov\b|coverage\s*:|nosec\b|"
    r"@formatter\s*:|suppress\s+\w+|spotless:|detekt:|ktlint|lint:|deno-(?:lint|fmt)-ignore|export\s+\w+$|line\s+\d+|sourcemappingurl)"
)
_LICENCE = re.compile(r"(?i)\bcopyright\b|\bspdx-license-identifier\b|\blicen[sc]ed under\b|\ball rights reserved\b|\bpermission is hereby granted\b|\b(?:mit|bsd|apache|gpl|mozilla public) licen[sc]e\b|\(c\)\s+(?:\d{4}|the\b)")
_TAG = re.compile(r"^\s*(?:<p>\s*)?(?:[@\\]\w+|:(?:param|parameter|arg|argument|key|keyword|type|raises?|except|exception|return|returns|rtype|var|ivar|cvar|vartype|meta)\b[^:]*:)")
_KEPT_TAG = re.compile(r"^\s*[@\\](?:summary|brief|description|desc|details|remarks|note)\b\s*")
_SECTION = re.compile(r"(?i)^\s*(?:#+\s*)?(?:args|arguments|parameters|params|returns?|raises|throws|yields?|exceptions|errors|examples?|panics|safety|attributes|see also|keyword args|other parameters)\s*:?\s*$")
_WORD = re.compile(r"[^\W_]+(?:['’.\-/][^\W_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
# Words that add nothing to a name.
_EMPTY = set("a an the this that these those it its is are be does do for of to in on at by with from and or method function func helper routine procedure member getter setter constructor implementation".split())
_CODE_LINE = re.compile(
    r"^(?:.*[;{}]|.*\)\s*=>.*|(?:if|elif|for|while|with|try|except|else|finally|def|class|async def|match|case|switch|catch|fn|func)\b.*:|(?:if|for|while|switch)\s*\(.*|(?:let|const|var|val|int|long|double|float|boolean|String|auto|mut|final)\s+[\w<>\[\], ]+\s*[:=].*|"
    r"[\w.$\[\]'\"]+\s*(?:[-+*/%&|^]|<<|>>|:|\*\*|//)?=(?!=)\s*\S.*|return\b\s*[\w.\[\](){}'\"+*/%<>=!-]*|[\w.$]+\([^()]*\)|import\s+\S+|from\s+\S+\s+import\s.*|raise\s+\w+\(.*|throw\s+new\s.*|panic\(.*|pass|break|continue|[)\]}]+[,;]?|\"[^\"]*\"\s*:\s*.*,?|'[^']*'\s*:\s*.*,?)$"
)


def strip_marks(comment: str) -> list[str]:
    """Lines of a comment without its marks."""
    text = comment
    if text.startswith("/*"):
        text = re.sub(r"\*/\s*$", "", re.sub(r"^/\*+!?", "", text))
        return [re.sub(r"^\s*\*+ ?", "", line) if re.match(r"^\s*\*", line) else line for line in re.split(r"\r\n?|\n", text)]
    return [re.sub(r"^\s*(?://+!?|#+!?) ?", "", line) for line in re.split(r"\r\n?|\n", text)]


def docstring_lines(literal: str) -> list[str]:
    body = re.sub(r"^[rRuU]*", "", literal)
    quote = body[:3] if body[:3] in ('"""', "'''") else body[:1]
    return re.split(r"\r\n?|\n", body[len(quote) : -len(quote)])


def prose_lines(lines: list[str]) -> list[str]:
    """The lines that describe: without directives, licence notes, and tags with what follows them up to a blank line."""
    out, skipping = [], False
    for line in lines:
        if not line.strip():
            skipping = False
            out.append("")
            continue
        if _KEPT_TAG.match(line):
            line, skipping = _KEPT_TAG.sub("", line), False
        elif _TAG.match(line) or _SECTION.match(line):
            skipping = True
        if skipping or _DIRECTIVE.match(line) or _LICENCE.search(line):
            continue
        out.append(re.sub(r"</?(?:p|br|code|pre|b|i|em|ul|li)\s*/?>|\{@\w+\s+([^}]*)\}", r"\1", line))
    return out


def _stems(name: str) -> set[str]:
    return {_stem(p.lower()) for p in _NAME_PART.findall(name)}


def _stem(word: str) -> str:
    for _ in range(2):
        end = next((e for e in ("ing", "ies", "es", "ed", "s", "e", "y") if word.endswith(e) and len(word) - len(e) >= 2), "")
        word = word[: len(word) - len(end)]
    return word


def restates(text: str, name: str) -> bool:
    """Whether every word of the text is a part of the name or an empty word."""
    own = _stems(name)
    for word in _WORD.findall(re.sub(r"[_()]", " ", text)):
        for part in _NAME_PART.findall(word) or [word]:
            part = part.lower()
            if part not in _EMPTY and _stem(part) not in own:
                return False
    return True


def looks_like_code(lines: list[str]) -> bool:
    kept = [x.strip() for x in lines if x.strip()]
    return bool(kept) and 2 * sum(bool(_CODE_LINE.match(x)) for x in kept) >= len(kept) + (len(kept) > 1)


def description(lines: list[str], name: str) -> str | None:
    """The text of a comment as one line if it is real documentation, else None.

    Trivial: fewer than four words, only the name again, a placeholder, a tool directive, code that was commented out, a licence note.
    """
    if looks_like_code(lines):
        return None
    text = " ".join(" ".join(prose_lines(lines)).split())
    words = [w for w in text.split() if _LETTER.search(w)]
    if len(words) < 4 or _PLACEHOLDER.match(text) or restates(text, name):
        return None
    return text


def _header_start(lang: str, lexed: Lexed, f: Island, partner: list[int]) -> int:
    """Index of the first token of the declaration with its modifiers, decorators, annotations and attributes."""
    tokens, k = lexed.tokens, f.token
    if lang in ("java", "rs"):
        while k > 0:
            kind, text, _, _ = tokens[k - 1]
            if kind == "p" and text in (")", "]") and partner[k - 1] >= 0:
                k = partner[k - 1]
            elif kind == "p" and text in ("{", "}", ";") or kind == "p" and text == "," and lang == "java":
                break
            else:
                k -= 1
        return k
    words = _MODIFIERS[lang]
    while k > 0 and tokens[k - 1][1] in words and (tokens[k - 1][0] == "i" or tokens[k - 1][1] == "*"):
        k -= 1
    if lang in ("py", "js", "ts"):
        while k > 0:  # decorators end right before
            j = k - 1
            if tokens[j][1] == ")" and partner[j] >= 0:
                j = partner[j] - 1
            while j > 0 and tokens[j][0] == "i" and tokens[j - 1][1] == ".":
                j -= 2
            if j > 0 and tokens[j][0] == "i" and tokens[j - 1][1] == "@":
                k = j - 1
                while k > 0 and lang != "py" and tokens[k - 1][1] in words:
                    k -= 1
            else:
                break
    return k


def _last_token(lang: str, parser: Parser, f: Island) -> int:
    """Index of the last token of a function whose declaration was matched: of its body in braces, of an arrow's expression, or of
    the declaration if there is no body."""
    tokens, partner, n = parser.tokens, parser.partner, len(parser.tokens)
    j = end = min(f.end, n)
    if lang in ("js", "ts"):
        if tokens[end - 1][1] == "=>":
            return _expression_end(lang, parser, end)
        if tokens[end - 1][1] != ")":  # the match holds the body
            return end - 1
        if j < n and tokens[j][1] == ":":  # a type may hold braces; the body's stand after a whole type
            ends = sorted(e for e, _ in parser.parse("Annotation", j) if j + 1 < e < n)
            j = next((e for e in ends if tokens[e][1] == "{" and tokens[e - 1][1] not in ("|", "&", "=>", ".", "?", "is", "keyof", "extends")), n)
        return partner[j] if j < n and tokens[j][1] == "{" and partner[j] > 0 else end - 1
    while j < n and tokens[j][1] not in (";", "}"):
        if lang == "go" and tokens[j][3] != tokens[j - 1][3]:  # the body begins on the line where the result ends
            break
        if tokens[j][1] == "{" and tokens[j - 1][1] not in ("struct", "interface", "<"):
            return partner[j] if partner[j] > 0 else end - 1
        j = partner[j] + 1 if tokens[j][1] in ("(", "[", "{") and partner[j] > j else j + 1
    return end - 1


_GOES_ON = {"in", "instanceof", "as", "satisfies"}
_WANTS_MORE = _GOES_ON | {"await", "new", "typeof", "void", "delete", "yield", "async", "function", "class", "extends"}


def _expression_end(lang: str, parser: Parser, at: int) -> int:
    """Index of the last token of the arrow body that begins at a position: a block, or an expression up to a ``,``, a ``;``, a closing
    bracket, or a line that cannot carry it on."""
    tokens, partner, n = parser.tokens, parser.partner, len(parser.tokens)
    if at < n and tokens[at][1] == "{" and tokens[at][0] == "p":
        return partner[at] if partner[at] > 0 else at - 1
    j, last = at, at - 1
    while j < n:
        kind, text, _, line = tokens[j]
        if kind == "p" and text in (",", ";", ")", "]", "}"):
            break
        if j > at and line != tokens[last][3]:
            before = tokens[last]
            whole = before[1] in (")", "]", "}", "++", "--") if before[0] == "p" else before[1] not in _WANTS_MORE
            if whole and (text in ("{", "++", "--", "!", "@", "~") if kind == "p" else text not in _GOES_ON):
                break
        if kind == "p" and text in ("(", "[", "{"):
            if partner[j] < 0:
                break
            j = partner[j]
        elif lang == "ts" and text == "<" and kind == "p":  # type arguments of a call or a cast
            end = parser._angles(j)
            if end > 0 and (end < n and tokens[end][1] == "(" or tokens[j - 2][1] in ("as", "satisfies")):
                j = end - 1
        last = j
        j += 1
    return last


def documented_functions(lang: str, lexed: Lexed, text: str) -> list[tuple[Island, str | None, int, int]]:
    """(declaration, description or None, first line, last line) of every function of a file."""
    parser = Parser(lang, lexed)
    tokens, starts = lexed.tokens, lexed.starts
    ending: dict[int, int] = {}  # comments that stand alone on their lines, by last line
    for i, (_, at, first, last) in enumerate(lexed.comments):
        if not text[starts[first - 1] : at].strip():
            ending[last] = i
    out = []
    for f in parser.functions():
        first = _header_start(lang, lexed, f, parser.partner)
        said = None
        lines = sorted({tokens[j][3] for j in range(first, f.token + 1)}, reverse=True)
        for line in lines:
            i = ending.get(line - 1)
            if i is None:
                continue
            block, up = [], i
            while True:  # line comments of consecutive lines, and blocks on top of each other, are one comment
                block.insert(0, lexed.comments[up])
                before = ending.get(block[0][2] - 1)
                if before is None or before == up:
                    break
                up = before
            said = None
            raw: list[str] = []
            for c in block:
                raw += strip_marks(c[0])
            said = description(raw, f.name)
            if said:
                break
        if said is None and lang == "py":
            j = f.end
            if j < len(tokens) and tokens[j][0] == "s" and tokens[j][1].lstrip("rRuU")[:1] in ("'", '"') and (j + 1 >= len(tokens) or tokens[j + 1][3] > tokens[j][3]):
                said = description(docstring_lines(tokens[j][1]), f.name)
        last = tokens[min(f.end, len(tokens)) - 1][3]
        if lang in ("js", "ts", "go", "rs"):
            last = max(last, tokens[_last_token(lang, parser, f)][3])
        elif lang == "py":
            j = f.end
            column = tokens[first][2] - starts[tokens[first][3] - 1]
            while j < len(tokens) and (tokens[j][3] == tokens[f.end - 1][3] or tokens[j][2] - starts[tokens[j][3] - 1] > column or tokens[j - 1][3] == tokens[j][3]):
                last = max(last, tokens[j][3])
                j += 1
        out.append((f, said, tokens[first][3], last))
    return out


def template_of(text: str, name: str) -> str:
    """A description with its own name, identifiers and numbers masked."""
    masked = text.replace(name, "\0")
    return re.sub(r"\d+", "0", re.sub(r"\w*[a-z][A-Z]\w*|\w+_\w+|`[^`]*`", "\0", masked)).lower()


_FUNCTIONS = "file_id long, path string, fault string, name string, start_line int, code string, description string, template string"


def extract_functions(files: DataFrame, with_code: bool = True) -> DataFrame:
    """One row per named function of every file: file_id, path, fault, name, start_line, code, description, template.

    ``start_line`` is the line of the name. ``fault`` says why the file is broken, if it is; its intact functions come out all
    the same. ``description`` is null where the comment and docstring are missing or trivial. Null content and unknown extensions give no rows.
    """
    ship(files.sparkSession)
    columns = [c.split()[0] for c in _FUNCTIONS.split(", ")]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for fid, path, text in zip(b["file_id"], b["path"], b["content"], strict=True):
                lang = language_of(path)
                if lang is None or not text:
                    continue
                lexed = lex(lang, text)
                fault = syntax_fault(lang, text, lexed)
                lines = None
                for f, said, first, last in documented_functions(lang, lexed, text):
                    code = None
                    if with_code:
                        lines = lines or text.splitlines()
                        code = "\n".join(lines[first - 1 : last])
                    rows.append((fid, path, fault, f.name, f.line, code, said, said and template_of(said, f.name)))
            yield pd.DataFrame(rows, columns=columns)

    rows = files.where("file_id is not null and content is not null").select("file_id", "path", "content")
    return rows.mapInPandas(extract, _FUNCTIONS)


def function_pairs(files: DataFrame, nodes: DataFrame, *, with_code: bool = True, template_share: float = 0.001, template_words: int = 6) -> DataFrame:
    """file_id, start_line, name, code, description, origin (``comment`` or ``summary``), fault: the functions with real documentation.

    Where the source has none, the ``ready`` summary of the node with the same path and start_line speaks, under the same rules.
    A description whose masked template makes up at least ``template_share`` of all descriptions and has at most
    ``template_words`` words is dropped as boilerplate; there are at most 1 / share such templates, so they are broadcast.
    Longer repeated sentences are documentation that several functions share. Repeated rows give one pair.
    """
    key = ["file_id", "start_line", "name"]
    found = materialize(extract_functions(files, with_code).dropDuplicates(key), "functions")  # repeated files count once
    ship(files.sparkSession)
    own = found.where("description is not null").withColumn("origin", F.lit("comment"))
    silent = found.where("description is null").drop("description", "template")
    enough = F.size(F.split(F.trim("summary"), r"\s+")) >= 4
    summaries = nodes.where("summary_state = 'ready' and summary is not null and path is not null and start_line is not null").where(enough)
    summaries = summaries.select(path_key("path").alias("path"), "start_line", "summary").distinct()

    @F.pandas_udf("string")
    def real(summary: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([description(re.split(r"\r\n?|\n", s), n) for s, n in zip(summary, name, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def template(text: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([t and template_of(t, n) for t, n in zip(text, name, strict=True)], dtype=object)

    told = silent.join(summaries, ["path", "start_line"]).withColumn("description", real("summary", "name")).where("description is not null")
    told = told.withColumn("template", template("description", "name")).withColumn("origin", F.lit("summary"))
    columns = ["file_id", "start_line", "name", "code", "description", "template", "origin", "fault"]
    pairs = own.select(columns).unionByName(told.select(columns))
    short = pairs.where(F.size(F.split("template", " ")) <= template_words)
    total = pairs.agg(F.count("*").alias("n"))
    common = short.groupBy(F.xxhash64("template").alias("hash")).agg(F.count("*").alias("times")).join(F.broadcast(total), F.col("times") >= F.greatest(F.lit(20), F.col("n") * template_share)).select("hash")
    kept = pairs.withColumn("hash", F.xxhash64("template")).join(F.broadcast(common), "hash", "left_anti")
    return kept.drop("hash", "template").dropDuplicates(key)


def documented(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_id, start_line of the documented functions of files that are valid in their language."""
    return function_pairs(files, nodes, with_code=False).where("fault is null").select("file_id", "start_line").distinct()
