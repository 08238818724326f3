"""Statistics of one text that tell natural prose from lists, tables, code and junk."""

from __future__ import annotations

import re

# The commonest words of each language, and its letters beside the Latin alphabet.
COMMON_WORDS = {
    "en": set("the of and to in a is that it was for on are as with his they be at one have this from or had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more go see no way could people my than first been who its now find long down did get come made may part over so only after before both again any because does where even here whether since while though although yet rather most once still also our us you i those such few without against between under must should might never always nobody anyone everything something nothing".split()),
    "de": set("der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine kein uns ohne beim nie erst ob was warum damit jeden jedem beide beiden trotzdem weil ihr dessen deren alle immer nichts niemand lange bevor bleibt".split()),
    "fr": set("de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont ou avec son lui nous comme mais on y si leur tout elle aux même ces sans fait été être avant après peut deux ont cette cela entre encore où dont ses sa sous vers quand tant rien déjà donc ainsi car je vous ils leurs notre chaque aucun jamais toujours lorsque faut mieux vaut".split()),
    "es": set("de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada e vida otro después te otros aunque esa eso hace otra tan durante siempre nadie antes quien cual nada poco sea hacía basta queda".split()),
}
_ALL_COMMON = frozenset().union(*COMMON_WORDS.values())
# What a common word adds to the counts of a token (see _Tokens): one common word, and one in each language that has it.
_COMMON = {w: (1 << 32) + sum((w in known) << 32 * k for k, known in enumerate(COMMON_WORDS.values(), 8)) for w in _ALL_COMMON}

_LINE = re.compile(r"\r\n?|[\n\v\f\x85\u2028\u2029]")
_WORD = re.compile(r"(?<!\d)[^\W\d_]+(?:['’][^\W\d_]+)*(?!\d)")  # not the letters of a number such as 3f
_OUTER = ".,;:!?…\"'”»)]([«“‘’-–—"
_SENTENCE = re.compile(r"[.!?…:;][\"'”»)\]]*\s+")
_CLAUSE = re.compile(r"[,;:|/\t()\[\]{}<>=•·→]|\s(?:[-–—]+\s|\s\s+)")
_MARK = re.compile(r"[,;:|/()\[\]{}<>=•·→]")  # the clause marks that are no white space
_LEAD = re.compile(r"^(?:\s*>)+\s?|^\s*(?:[-*+•→◦▪]|\d{1,3}[.)]|\(?[a-z]\))\s+|^\s*[A-Z][A-Za-z]{0,11}:\s+(?=\S+\s\S+\s\S+)")
_LOWER = frozenset("abcdefghijklmnopqrstuvwxyz")  # what begins so has a lead only as in "a) "
_NO_PROSE = re.compile(
    r"\s*(?://|/\*|\*/|\*\s|\*$|#!|@@|[+-]{1,3}(?=\S)|@\w|\$\s|>>>\s|at\s+[\w.$]+\(|<[/!a-zA-Z]|"
    r"(?:def|class|import|from|return|if|for|while|func|fn|pub|use|let|const|var|export|function|package|public|private|static)\b.*[:;{}()=]\s*$|"  # code
    r"\|.*\|\s*$|[-=+|: ]{6,}$|#{1,6}\s|"  # table rows, rules, headings
    r"\[?\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|\[?(?:INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b|[\w.\-]+\s*[=:]\s*\S*\s*$|[\w.\-/\\]+\.\w{1,5}(?::\d+)?\s*$)"  # log lines, settings, paths
)
_DOCSTRING = re.compile(r"""[rRuU]?(\"\"\"|''')""")
_OPERATORS = re.compile(r"[=(){}\[\]<>+]|\breturn\b")
_GAP = re.compile(r"\S {3,}(?=\S)")
_CELLS = re.compile(r"\s*(?:[^,\s][^,]*,){3,}[^,\s]*$")
_NOISE = re.compile(r"</?\w+>|<\|\w+\|>|\[[A-Z]+\]|\d[\d.,]*|\s{2,}")
_BLANK = re.compile(r"[\s\u200b-\u200f\u2060\ufeff]*\Z")
_DIGITS = re.compile(r"\d+")
WRAP = 38  # a line of at least this length and five words may go on in the next

KEPT_TOKENS, KEPT_LENGTH = 1 << 16, 128  # so many tokens are remembered, up to this length
_COUNT = (1 << 32) - 1  # a text has fewer characters


class _Tokens(dict):
    """The counts of a token between white space, by token: those of a text, or a part of it, are the sums over its tokens.

    A count takes 32 bits of the number: words, common words, 1 for a clause mark inside, 1 for dashes alone, characters, letters, digits, 1 for
    letters alone within punctuation, and the common words of each language. No word reaches beyond white space and neither does the case of a letter,
    so a token counts the same in every text, and one seen before is not scanned again.
    """

    def __missing__(self, token: str) -> int:
        low = token.lower()
        plain = low.isalpha()
        words = (low,) if plain else _WORD.findall(low)
        packed = len(words) | len(token) << 128 | sum(map(len, words)) << 160 | token.replace("'", "").replace("’", "").strip(_OUTER).isalpha() << 224
        if not plain:
            packed |= (_MARK.search(token) is not None) << 64 | (not token.strip("-–—")) << 96 | sum(map(len, _DIGITS.findall(token))) << 192
        for word in words:
            if word in _COMMON:
                packed += _COMMON[word]
        if len(token) <= KEPT_LENGTH:
            if len(self) >= KEPT_TOKENS:
                self.clear()
            self[token] = packed
        return packed


_TOKENS = _Tokens()
_counts = _TOKENS.__getitem__


def _lines(text: str) -> list[str]:
    """The lines of a text; empty ones at its end may be missing."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text:  # separators to Python, no line ends here
        return _LINE.split(text)
    return text.splitlines()


def _is_row(line: str) -> bool:
    """Whether a line is a table row in columns of spaces: two wide gaps or more and few words."""
    return len(line.split()) <= 8 and len(_GAP.findall(line)) >= 2


def _units(lines: list[str]):
    """Paragraph pieces as (text, is_prose_like): wrapped lines joined, list items, table rows, log lines and code apart."""
    piece, fenced, quoted = "", False, False
    for line in lines:
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            if piece:
                yield piece, True
            piece, fenced = "", not fenced
            yield bare, False
            continue
        if not bare:
            if piece:
                yield piece, True
            piece = ""
            continue
        quote = bare[0] in "rRuU\"'" and _DOCSTRING.match(bare)
        if quote:  # a docstring belongs to code
            quoted = not quoted and bare.count(quote[1]) < 2
        if fenced or quote or quoted or bare[-1] in "{}" or bare[-1] == ";" and (_OPERATORS.search(bare) or bare.count(" ") < 4) or line.count("\t") > 2 or "   " in bare and _is_row(bare) or _NO_PROSE.match(line) or bare.count(",") > 2 and _CELLS.match(line):
            if piece:
                yield piece, True
            piece = ""
            yield bare, False
            continue
        size, m = len(bare), None if bare[0] in _LOWER and bare[1:2] != ")" else _LEAD.match(line)
        if m:
            bare = line[m.end() :].strip() or bare
        if piece and m is None or piece and line.lstrip().startswith(">"):
            piece += " " + bare
        else:
            if piece:
                yield piece, True
            piece = bare
        if size < WRAP or line.count(" ") < 4:
            yield piece, True
            piece = ""
    if piece:
        yield piece, True


def _is_sentence(part: str, weight: int, tokens: list[str], counts: int) -> bool:
    """Whether a part is a sentence: its characters without spaces, its tokens and the sum of their counts are given."""
    n, ended = counts & _COUNT, part.rstrip("\"'”»)] ")[-1:] in (".", "!", "?", "…", ":", ";")
    if n < (5 if ended else 7) or (counts >> 32 & _COUNT) < 0.22 * n:
        return False
    if counts >> 96 & _COUNT or counts >> 128 & _COUNT != weight or "   " in part:  # dashes that stand alone, white space beside spaces, gaps
        clauses = _CLAUSE.split(part)
    elif counts >> 64 & _COUNT:
        clauses = _MARK.split(part)
    else:  # one clause
        return len(tokens) >= 5 or len(tokens) == 4 and ended and n <= 12
    sizes = [len(c.split()) for c in clauses]
    longest, filled = max(sizes), sum(map(bool, sizes))
    if filled >= 4 and n < 3.2 * filled:  # a list on one line, unless stray tokens cut a sentence up
        sizes = [len(_WORD.findall(c)) for c in _CLAUSE.split(_NOISE.sub(" ", part))]
        longest, filled = max(sizes), sum(c > 0 for c in sizes)
        if filled >= 4 and n < 2.8 * filled:
            return False
    return longest >= 5 or longest >= 4 and ended and n <= 12


def sentence_chars(text: str) -> tuple[int, int]:
    """(characters in running sentences, all characters), white space apart."""
    return _sentence_chars(_lines(text))


def _sentence_chars(lines: list[str]) -> tuple[int, int]:
    inside = total = 0
    for unit, prose in _units(lines):
        total += len(unit) - unit.count(" ")
        if not prose:
            continue
        kept = short = at = 0
        ends = [m.end() for m in _SENTENCE.finditer(unit)]
        for end in [*ends, len(unit)]:
            part, at = unit[at:end].rstrip(), end
            tokens = part.split()
            counts = sum(map(_counts, tokens))
            n, weight = counts & _COUNT, len(part) - part.count(" ")
            if n >= 5 and _is_sentence(part, weight, tokens, counts):
                kept += weight
            elif 0 < n < 7:
                short += weight
        # a short sentence among others belongs to them
        inside += kept + (short if kept > 2 * short else 0)
    return inside, total


STATISTICS = ["n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "sentence_share", "repeated_lines", "word_tokens", "words_per_line"]


def statistics(text: str | None) -> tuple[str, list[float]] | None:
    """(language, values of :data:`STATISTICS`) of a text; None for a null text or one of white space only.

    The language is the one whose common words are most frequent, ``other`` where they make up less than a twentieth.
    """
    if not text or _BLANK.match(text):
        return None
    tokens = text.split()
    counts = sum(map(_counts, tokens))
    n, common, _, _, solid, letters, digits, alphabetic, *spoken = (counts >> 32 * k & _COUNT for k in range(8 + len(COMMON_WORDS)))
    most = max(spoken)
    lang = list(COMMON_WORDS)[spoken.index(most)] if n and most >= 0.05 * n else "other"
    raw = _lines(text)
    lines = [x for x in (y.strip() for y in raw) if x]
    inside, total = _sentence_chars(raw)
    return lang, [
        float(len(text)),
        float(n),
        letters / n if n else 0.0,
        max(0, solid - letters - digits) / solid,
        digits / solid,
        sum(x[-1] in ".!?…:;\"'”»)" for x in lines) / len(lines),
        common / n if n else 0.0,
        inside / total if total else 0.0,
        1 - len(set(lines)) / len(lines),
        alphabetic / len(tokens),
        n / len(lines),
    ]
