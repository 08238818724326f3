"""Scalar text and path functions as Catalyst expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the tokenizer.
STOP_WORDS = [
    "the", "a", "an", "of", "to", "in", "is", "are", "how", "does", "do", "what", "where", "which", "that", "this",
    "it", "for", "on", "and", "or", "with", "i", "we", "get", "set", "use", "used", "using", "when", "why", "can",
]
# Three different notions of a test path, one per command; never share them.
TEST_PATH_ASK = r"(?i)(^|/)(tests?|__tests__|spec)/|(_test|\.test|\.spec)\.[a-z]+$|_tests\.rs$|(^|/)tests?\.rs$|(^|/)(test_[^/]+|conftest)\.py$"
TEST_PATH_IMPACT = r"(?i)(^|/)(tests?|specs?|__tests__)/|\.(test|spec)\.[cm]?[jt]sx?$|_test\.(go|py|rb)$"
TEST_PATH_WHY = r"^tests/|/tests/|/test/|(^|/)test_[^/]*$|_test\.[^/]*$|\.test\.[^/]*$|\.spec\.[^/]*$|\.md$"
WANTS_TESTS = r"(?i)(?<![A-Za-z0-9_])(tests?|specs?|coverage|assert(?:ion)?s?|fixtures?|mocks?)(?![A-Za-z0-9_])"
BOT_NAME = r"(?i)^(github-actions|dependabot|renovate)(\[bot\])?$|\[bot\]"
# Words that make a comment a reason.
REASON = r"(?<![A-Za-z0-9_])(SAFETY|WHY|NOTE|HACK|TODO|FIXME)(?![A-Za-z0-9_])|(?i:(?<![A-Za-z0-9_])(because|so that|never)(?![A-Za-z0-9_]))"
# Language families between which names may not link.
FAMILIES = {"js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "ts": "script", "tsx": "script", "py": "python", "java": "jvm", "kt": "jvm", "scala": "jvm", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "c", "hpp": "c", "cs": "dotnet", "php": "php", "rb": "ruby", "swift": "swift"}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits, camel case split, without single characters and stop words; null gives null."""
    spaced = F.lower(F.regexp_replace(col(text), r"([a-z0-9])(?=[A-Z])", "$1 "))
    return F.filter(F.regexp_extract_all(spaced, F.lit(r"[a-z0-9]{2,}"), 0), lambda t: ~t.isin(STOP_WORDS))


def query_terms(query: str) -> list[str]:
    """Unique tokens of a query in order; in ``how does ... work`` the last word is no term."""
    spaced = re.sub(r"([a-z0-9])(?=[A-Z])", r"\1 ", query).lower()
    terms = list(dict.fromkeys(t for t in re.findall(r"[a-z0-9]+", spaced) if len(t) > 1 and t not in STOP_WORDS))
    words = [w.lower() for w in re.split(r"[^A-Za-z0-9]+", query) if w]
    if len(words) >= 3 and words[0] == "how" and words[1] in ("does", "do") and words[-1] in ("work", "works"):
        terms = [t for t in terms if t not in ("work", "works")]
    return terms


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def file_stem(path: str | Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def parent_dir(path: str | Column) -> Column:
    """Folder of a path; ``.`` for a file at the top."""
    c = col(path)
    return F.when(c.contains("/"), F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit("."))


def dir_key(path: str | Column, depth: int) -> Column:
    """The first ``depth`` folders of a path; ``.`` for a file at the top."""
    parts = F.split(col(path), "/")
    folders = F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1))
    return F.when(F.size(parts) > 1, F.array_join(folders, "/")).otherwise(F.lit("."))


def dir_prefixes(path: str | Column) -> Column:
    """All folders above a path, from the top."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def path_suffixes(path: str | Column) -> Column:
    """All tails of a path that begin at a segment, the whole path first."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def family(path: str | Column) -> Column:
    """Language family of a path by extension; null for an unknown one."""
    ext = F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.try_element_at(table, ext)


def under(path: str | Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it; an empty prefix holds for all. Leading ``./`` and trailing ``/`` of the prefix do not count."""
    p = re.sub(r"^(\./)+", "", prefix).rstrip("/")
    c = col(path)
    return F.lit(True) if not p else (c == p) | c.startswith(p + "/")


def strip_ordinals(node_id: str | Column) -> Column:
    """An id without the ordinals ``~2``, ``~3`` of repeated names."""
    return F.regexp_replace(col(node_id), r"~[0-9]+(?=\.|$)", "")


def collapse_space(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(text), r"[\s\x{FEFF}]+", " "))


def utf16_length(text: str | Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("bigint")


def cut_units(text: str | Column, units: int) -> Column:
    """At most ``units`` UTF-16 code units, without half a character at the end."""
    c = col(text)
    rough = F.substring(c, 1, units)
    fits = utf16_length(rough) <= units
    step = F.filter(F.transform(F.sequence(F.lit(1), F.length(rough)), lambda n: F.substr(rough, F.lit(1), n)), lambda s: utf16_length(s) <= units)
    return F.when(fits, rough).otherwise(F.element_at(step, -1))


def normalize_heading(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[—–,\s]+", " "))


def round_tokens(chars: str | Column) -> Column:
    """Tokens of a number of characters, four to one, rounded."""
    return F.floor((col(chars) + 2) / 4).cast("bigint")


def half_life(age_days: Column, days: float) -> Column:
    return F.pow(F.lit(0.5), age_days / days)


def thousands(n: str | Column) -> Column:
    """A whole number with a comma every three digits."""
    return F.format_number(col(n), 0)


def short_number(n: str | Column) -> Column:
    """A count as it stands below 1,000, with one decimal and ``k`` below 10,000, with ``k`` alone above."""
    c = col(n).cast("bigint")
    tenths = F.floor((c + 50) / 100)
    small = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))
    return F.when(c < 1000, c.cast("string")).when(tenths < 100, small).otherwise(F.concat(F.floor((c + 500) / 1000).cast("string"), F.lit("k")))


# Words before the name in a signature, and words after which a label may end.
SIGNATURE_MODIFIERS = ["export", "pub", "default", "async", "declare", "abstract", "static", "public", "private", "protected", "override", "readonly"]
SIGNATURE_KEYWORDS = [r"function\*", "function", "interface", "class", "type", "enum", "const", "let", "var", "def", "fn", "struct", "trait"]
CLAUSE_WORDS = ["via", "and", "for", "with", "using", "in", "across", "over", "from", "of", "by", "to"]
_WS = r"[\t\n\x0B\x0C\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim_signature(name: str | Column, signature: str | Column) -> Column:
    """A signature without modifiers, keyword and name; null where nothing is left."""
    bare = F.regexp_replace(F.trim(col(signature)), rf"^(?:(?:{'|'.join(SIGNATURE_MODIFIERS)}) \s*)*", "")
    bare = F.regexp_replace(bare, rf"^(?:{'|'.join(SIGNATURE_KEYWORDS)}) \s*", "")
    n = F.coalesce(col(name), F.lit(""))
    after = F.regexp_replace(F.ltrim(F.substr(bare, F.length(n) + 1)), "^= ", "")
    return F.nullif(F.when(bare.startswith(n), after).otherwise(bare), F.lit(""))


def short_label(text: str | Column) -> Column:
    """A label of at most 30 UTF-16 units: cut at the first clause break that leaves 8 units, else at the last space of the second half, else hard, with ``…``."""
    trim = lambda c: F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")
    bare = trim(F.regexp_replace(col(text), rf"^(?i:concepts?:){_WS}*", ""))
    at = F.regexp_instr(bare, F.lit(rf"{_WS}(?:\(|—|-{_WS})|:{_WS}|{_WS}(?i:{'|'.join(CLAUSE_WORDS)}){_WS}"))
    head = F.substr(bare, F.lit(1), F.greatest(F.lit(0), at - 1))
    rough = cut_units(bare, 31)
    space = F.length(rough) - F.locate(" ", F.reverse(rough)) + 1  # position of the last space
    before = F.substr(rough, F.lit(1), space - 1)
    cut = F.when((F.locate(" ", rough) > 0) & (utf16_length(before) > 15), before).otherwise(cut_units(bare, 30))
    return F.when(utf16_length(bare) <= 30, bare).when((at > 0) & utf16_length(head).between(8, 30), trim(head)).otherwise(F.concat(F.regexp_replace(cut, rf"{_WS}+$", ""), F.lit("…")))


# Parts of key names, and key prefixes with the least length of what follows.
KEY_WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey", "auth", "accountkey"]
KEY_PREFIXES = {"github_pat_": 8, "ghp_": 8, "gho_": 8, "glpat-": 8, "AKIA": 12, "AIza": 8, "sk-ant-": 8, "sk_live_": 8, "rk_live_": 8, "sk-": 8, "npm_": 36, "hf_": 30}


def _secret_rules() -> list[tuple[str, str]]:
    """What a secret looks like and what stands in its place, in the order the rules apply."""
    key = r"[A-Za-z0-9_]*(?:" + "|".join(KEY_WORDS) + r")[A-Za-z0-9_]*[\"']?\s*"
    auth = r"[A-Za-z0-9_]*auth[A-Za-z0-9_]*[\"']?\s*"
    value = r"[^\s;,]"
    heads = "|".join((r"sk-(?!ant-)" if p == "sk-" else re.escape(p)) + f"[A-Za-z0-9_-]{{{n},}}" for p, n in KEY_PREFIXES.items())
    return [
        (r"\x1B(?:\[[^\x40-\x7E]*[\x40-\x7E]?|\][^\x07\x1B]*[\x07\x1B]?)", ""),  # terminal codes
        (r"\t", " "),
        (r"[\x00-\x1F\x7F-\x9F]", ""),
        (r"-----BEGIN [\s\S]*?(?:-----END (?:[\s\S]*?-----|[\s\S]*\z)|\z)", "[redacted]"),  # key blocks, also open ones
        (r"(?i)([a-z][a-z0-9+.-]*://)[^/?#\s]*@", "$1"),  # credentials in addresses
        (
            rf"(?i)(?<![A-Za-z0-9_])(?:(bearer\s+){value}+|({key}(?:=(?![=>~])|:)\s*)(?:\"[^\"]*(?:\"|\z)|'[^']*(?:'|\z))|({key}=(?![=>~])\s*)(?![\"']){value}+|({auth}:\s*(?:basic|bearer)\s+){value}+)",
            "$1$2$3$4[redacted]",
        ),
        (rf"(?<![A-Za-z0-9])(?:xox[A-Za-z]-[A-Za-z0-9_-]{{8,}}|{heads}|(?=[A-Za-z0-9_.-]{{10}})eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_.-]*)", "[redacted]"),
        (r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/=]*[0-9])(?=[A-Za-z0-9+/=]*[+/=])[A-Za-z0-9+/=]{40,}", "[redacted]"),  # long base64 runs
    ]


SECRETS = _secret_rules()


def strip_controls(text: str | Column) -> Column:
    """The text on one line: without terminal codes and control characters, tabs as spaces."""
    out = col(text)
    for pattern, to in SECRETS[:3]:
        out = F.regexp_replace(out, pattern, to)
    return out


def redact(text: str | Column) -> Column:
    """The text on one line without secrets: terminal codes and control characters, private keys, credentials in addresses, literal values of key names,
    bearer and basic words, known key prefixes, signed tokens, long base64 runs. After a colon only a quoted value counts, so types stay."""
    out = col(text)
    for pattern, to in SECRETS:
        out = F.regexp_replace(out, pattern, to)
    return out
