"""Regex matching with RE2 semantics on Spark's Java regex engine.

RE2 and Java disagree on ``\\b`` (ASCII against Unicode), on ``\\s`` (Java adds
the vertical tab), on ``.`` before ``\\r`` and on case folding: under ``(?i)`` RE2
folds the long s to ``s``, Java also the dotless i to ``i``. ``java_pattern``
rewrites a pattern so that Java gives RE2's answer on lower-cased text, without
its case flags.

RE2 also reads every text once. Java restarts at each possible start, so ``a.*b``
takes quadratic time on a long line of ``a``; such alternatives are anchored to
the first start in a line, or in a run of the repeated class.

Patterns that start with whole words need no search each: ``first_words`` finds the
words of all of them in one pass over a text.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import chain, groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_S = "\u017f"
_KELVIN = "\u212a"
_SPACE = r"\t\n\f\r "
_WORD = rf"\w{LONG_S}"
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_TOKEN = re.compile(r"\\.|[\[\]]|[^\\\[\]]+", re.DOTALL)
_WORDS = re.compile(r"\(([a-z_]+(?:\|[a-z_]+)*)\)(?![?*{])|([a-z_])[a-z_]")
_REPEATED = re.compile(r"(?P<head>.+?)(?P<run>\.|\[[^\]]*\])\*(?P<tail>.+)", re.DOTALL)
_DOTTED_I = ("\u0130", "i")
_FEW = 4
_FIRST_WORD = re.compile(
    r"\\b(?:\((?P<words>[a-z_]+(?:\|[a-z_]+)*)\)|(?P<word>[a-z_]+))(?![?*{+])(?P<rest>.*)", re.DOTALL
)
# Spelled out: Java looks listed characters up in a table, and tries \w or what a class leaves out more slowly.
_WORD_CHARS = {*string.ascii_letters, *string.digits, "_"}
_NO_WORD = "[" + "".join(rf"\x{c:02x}" for c in range(256) if chr(c) not in _WORD_CHARS) + r"\x{100}-\x{10ffff}]"


def _boundary(rest: str) -> str:
    """An ASCII word boundary, tried only where one of the words that follow can start."""
    words = _WORDS.match(rest)
    if not words:
        return _BOUNDARY
    initials = {word[0] for word in (words[1] or words[2]).split("|")}
    if "s" in initials:
        initials.add(LONG_S)
    return f"(?=[{''.join(sorted(initials))}]){_BOUNDARY}"


def _translated(pattern: str) -> str:
    """Java tokens for RE2 tokens, one by one."""
    in_class = False
    out = []
    for found in _TOKEN.finditer(pattern):
        token = found.group()
        if token in "[]":
            in_class = token == "["
        elif token == r"\s":
            token = _SPACE if in_class else f"[{_SPACE}]"
        elif token == r"\w":
            token = _WORD if in_class else f"[{_WORD}]"
        elif token == r"\b":
            token = _boundary(pattern[found.end() :])
        elif not in_class and token[0] != "\\":
            token = token.replace("s", f"[s{LONG_S}]")
        out.append(token)
    return "".join(out)


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, or of the one group that is the whole pattern."""
    depth, cuts, closed = 0, [], False
    whole = pattern.startswith("(") and pattern.endswith(")")
    for place, char in enumerate(pattern):
        depth += (char == "(") - (char == ")")
        closed |= depth == 0 and place < len(pattern) - 1
        if char == "|" and depth == (0 if not whole else 1):
            cuts.append(place)
    if whole and closed:
        return [pattern]
    start, end = (1, len(pattern) - 1) if whole else (0, len(pattern))
    return [pattern[a + 1 : b] for a, b in zip([start - 1, *cuts], [*cuts, end])]


def _passes_over(run: str, head: str) -> bool:
    """Whether a class holds every printable ASCII character that the tokens of the head can match."""
    if run == ".":
        return True
    inside = re.compile(run, re.ASCII)
    tokens = re.findall(r"\[[^\]]*\]|\\.|[^\\\[\]]", re.sub(r"[()|?*+{}^$]|\\b", "", head))
    seen = [c for token in tokens for c in map(chr, range(32, 127)) if re.fullmatch(token, c, re.ASCII)]
    return all(inside.fullmatch(c) for c in seen)


def _read_once(alternative: str) -> str:
    """``head run* tail`` from the first head of each line or run: later heads see no more of it.

    That holds if the run can pass over any later head, so one with a character outside the class is an error.
    """
    found = _REPEATED.fullmatch(alternative)
    if not found:
        return _translated(alternative)
    if not _passes_over(found["run"], found["head"]):
        raise ValueError(f"{found['run']} doesn't hold all of {found['head']!r}: {alternative!r}")
    head, tail = _translated(found["head"]), _translated(found["tail"])
    if found["run"] == ".":
        return rf"^(?:(?!{head})[^\n])*+{head}[^\n]*{tail}"
    run = _translated(found["run"])
    return rf"(?<!{run})(?:(?!{head}){run})*+{head}{run}*{tail}"


def java_pattern(pattern: str) -> str:
    """The Java form, for lower-cased text, of a case-insensitive RE2 pattern.

    A class that is repeated between two parts must hold all characters of the first part.
    """
    alternatives = _alternatives(pattern.removeprefix("(?i)"))
    return "(?dm)(?:" + "|".join(map(_read_once, alternatives)) + ")"


def _word_rests(pattern: str) -> dict[str, str]:
    """What must follow each of the words a pattern starts with; a pattern that starts otherwise is an error."""
    rests = {}
    for alternative in _alternatives(pattern.removeprefix("(?i)")):
        head = _FIRST_WORD.fullmatch(alternative)
        if not head or _REPEATED.fullmatch(alternative):
            raise ValueError(f"doesn't start with a whole word: {alternative!r}")
        rests |= dict.fromkeys((head["word"] or head["words"]).split("|"), head["rest"])
    return rests


def _first_letters(words: Iterable[str]) -> str:
    """A test that most other words fail: one class for each of the first three letters."""
    return "".join(f"[{''.join(sorted(set(column)))}]" for column in [*zip(*words)][:3])


def _any_word(rests: dict[str, str]) -> str:
    """One alternative for each few initials, then for each initial, then for each word, with what must follow it."""
    initials = [[*words] for _, words in groupby(sorted(rests), key=lambda word: word[0])]
    groups = []
    for few in (initials[i : i + _FEW] for i in range(0, len(initials), _FEW)):
        branches = []
        for words in few:
            tails = "|".join(f"{word[1:]}(?={_translated(rests[word])})" for word in words)
            branches.append(f"{words[0][0]}(?:{tails})")
        groups.append(f"(?={_first_letters(chain(*few))})(?:{'|'.join(branches)})")
    return "|".join(groups)


def first_words(text: Column, signatures: Sequence) -> Column:
    """The first word, lower-cased, of every match of the signatures in a text that passed ``ascii_fold`` and has no long s.

    One pass over the text, in whatever case it is.
    Each match starts after a character that isn't part of a word; the blank put ahead is that of a match at
    the start. Nothing but that character is taken up, so matches may overlap. At most one word fits a place, so
    two patterns can't go on differently after the same word, and no word may start another one.
    """
    rests: dict[str, str] = {}
    for signature in signatures:
        for word, rest in _word_rests(signature.pattern).items():
            if rests.setdefault(word, rest) != rest:
                raise ValueError(f"two patterns go on differently after {word!r}")
    ordered = sorted(rests)
    for word, following in zip(ordered, ordered[1:]):
        if following.startswith(word):
            raise ValueError(f"{word!r} starts {following!r}")
    java = f"(?dm){_NO_WORD}(?i)(?={_first_letters(rests)})(?=({_any_word(rests)}))"
    return F.transform(F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(java), F.lit(1)), F.lower)


def starts_match(words: Column, signature, hits: int = 1) -> Column:
    """Whether ``hits`` or more of the found first words are the signature's."""
    own = sorted(_word_rests(signature.pattern))
    if hits == 1:
        return reduce(or_, [F.array_contains(words, F.lit(word)) for word in own])
    return F.size(F.filter(words, lambda word: word.isin(own))) >= hits


def search_text(*parts: Column) -> Column:
    """Lower-cased text of the parts, joined by a blank, nulls as empty.

    The capital dotted I becomes a plain i, not an i with a combining dot.
    """
    filled = [F.coalesce(part, F.lit("")) for part in parts]
    spaced = [piece for part in filled for piece in (F.lit(" "), part)][1:]
    return F.lower(F.replace(F.concat(*spaced), F.lit(_DOTTED_I[0]), F.lit(_DOTTED_I[1])))


def ascii_fold(text: Column) -> Column:
    """A text with a letter beyond ASCII that case folding makes an ASCII one, lower-cased by ``search_text``; any other as it is.

    Lower-casing changes no more than the case of ASCII letters for a pattern in the others, and takes as long as a search.
    """
    folds = reduce(or_, [F.contains(text, F.lit(letter)) for letter in (LONG_S, _DOTTED_I[0], _KELVIN)])
    return F.when(folds, search_text(text)).otherwise(text)


def folded(text: Column) -> Column:
    """Text for the substring test.

    The long s is the one letter that folds to ASCII in RE2's case-insensitive
    matching and survives ``lower``.
    """
    return F.replace(text, F.lit(LONG_S), F.lit("s"))


def may_match(plain: Column, needles: Sequence[str]) -> Column:
    """False only where no needle occurs in the folded text."""
    return reduce(or_, [F.contains(plain, F.lit(needle)) for needle in needles])


def matches(text: Column, plain: Column, signature) -> Column:
    """Whether the pattern occurs in the text; ``plain`` is the folded text."""
    return may_match(plain, signature.needles) & F.rlike(text, F.lit(java_pattern(signature.pattern)))


def matches_at_least(text: Column, plain: Column, signature, hits: int) -> Column:
    """Whether the pattern occurs ``hits`` times or more."""
    counted = F.regexp_count(text, F.lit(java_pattern(signature.pattern))) >= hits
    return may_match(plain, signature.needles) & counted


def label_each(text: Column, plain: Column, signatures: Sequence) -> Column:
    """Generator of one value per signature: its label where it occurs, else null.

    The generator's argument is a plain array, for which Catalyst adds no
    emptiness filter; such a filter would evaluate all the regexes twice.
    """
    return F.explode(F.array(*[F.when(matches(text, plain, s), F.lit(s.label)) for s in signatures]))
