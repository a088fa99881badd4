"""Text functions as Column builders; all stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from html.entities import name2codepoint
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """A function of a value: an array of one element holds the value, which each of its uses would compute anew."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _ranges(characters: Iterable[str]) -> str:
    """The inside of a character class."""
    codes, out = sorted(map(ord, characters)), []
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def _decompositions() -> tuple[str, str, dict[str, str], str]:
    """Of the basic plane: characters that decompose into one character and marks, and that one; those that decompose into
    several (ligatures, fractions, signs), with them; marks. Syllables of Hangul are left as they are."""
    single, several, marks = [], {}, []
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000)]):
        whole = unicodedata.normalize("NFKD", c)
        base = "".join(b for b in whole if not unicodedata.combining(b))
        if not base:
            marks.append(c)
        elif whole != c and len(base) == 1:
            single.append((c, base))
        elif whole != c and len(base) > 1:
            several[c] = base
    return "".join(a for a, _ in single), "".join(b for _, b in single), several, "".join(marks)


_ACCENTED, _BASE, _SEVERAL, _MARKS = _decompositions()
_LATIN_END = "\u0250"
#: White space that is not a single space.
_WIDE = "  |[\\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_PARTS = "\x1f".join(f"{c}\x1e{parts}" for c, parts in _SEVERAL.items())


def plain(value: str) -> str:
    """:func:`normalize` of a constant, on the driver."""
    folded = unicodedata.normalize("NFKD", (value or "").lower())
    return re.sub(r"\s+", " ", "".join(c for c in folded if not unicodedata.combining(c))).strip()


def _decomposed(lower: Column) -> Column:
    several, kind = F.str_to_map(F.lit(_PARTS), F.lit("\x1f"), F.lit("\x1e")), _ranges(_SEVERAL)
    pieces = F.regexp_extract_all(lower, F.lit(f"[{kind}]|[^{kind}]+"), F.lit(0))
    # a cheap look first: most texts have Latin letters alone
    maybe = lower.rlike(f"[{_ranges(c for c in _SEVERAL if c < _LATIN_END)}{_LATIN_END}-\uffff]")
    has = maybe & (F.length(F.translate(lower, "".join(_SEVERAL), "")) < F.length(lower))
    whole = F.when(has, F.array_join(F.transform(pieces, lambda p: F.coalesce(several[p], p)), "")).otherwise(lower)
    # marks have no counterpart, so that they are taken out
    return F.translate(whole, _ACCENTED + _MARKS, _BASE)


def normalize(text: Column) -> Column:
    """Lower case, without accents, white space collapsed; null gives an empty string.

    Characters of the basic plane are decomposed (NFKD): accented letters become their base, ligatures and signs the
    characters that they stand for, and combining marks are removed. Texts of ASCII alone are only put in lower case.
    """
    # most texts have single spaces already
    return F.trim(once(_bare(text), lambda bare: F.when(bare.rlike(_WIDE), F.regexp_replace(bare, "(?U)\\s+", " ")).otherwise(bare)))


def _bare(text: Column) -> Column:
    """:func:`normalize` before white space is collapsed."""
    # runs of ASCII, most of a text, stay as they are
    runs = lambda lower: F.array_join(F.transform(F.regexp_extract_all(lower, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0)), lambda run: F.when(run >= "\x80", _decomposed(run)).otherwise(run)), "")
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda lower: F.when(lower.rlike(r"[^\x00-\x7F]"), runs(lower)).otherwise(lower))


def canonical(text: Column) -> Column:
    """Words of letters, digits, + and # with single spaces between them, after :func:`normalize`."""
    # white space is among what becomes a space
    return F.trim(F.regexp_replace(_bare(text), "[^a-z0-9+#]+", " "))


def place_key(text: Column) -> Column:
    """Words of letters and digits with single spaces between them, after :func:`normalize`."""
    return F.trim(F.regexp_replace(_bare(text), "[^a-z0-9]+", " "))


def _character(code: Column) -> Column:
    """The character of a code point; those that no text may hold give U+FFFD."""
    fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")).when(code.isNotNull(), "\ufffd")


#: Names of HTML 4 characters, as one constant.
_NAMES = "\x1f".join(f"{name}\x1e{chr(code)}" for name, code in [*name2codepoint.items(), ("apos", 39)])


def unescape(text: Column) -> Column:
    """Text with numeric and named (HTML 4) character references taken as the characters that they stand for.

    A reference is one pass: ``&amp;lt;`` gives ``&lt;``. References without a semicolon and unknown names stay.
    """
    names = F.str_to_map(F.lit(_NAMES), F.lit("\x1f"), F.lit("\x1e"))
    part = F.regexp_extract_all(text, F.lit(r"(?s)&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]++|&"), F.lit(0))

    def one(p: Column) -> Column:
        inner = F.substring(p, 2, F.length(p) - 2)
        number = F.when(inner.rlike("^#[0-9]"), F.substring(inner, 2, 9).try_cast("long")).when(inner.rlike("^#[xX]"), F.conv(F.substring(inner, 3, 9), 16, 10).try_cast("long"))
        return F.when(p.rlike(r"\A&[^&]*;\z"), F.coalesce(_character(number), names[inner], p)).otherwise(p)

    return F.when(text.contains("&"), F.array_join(F.transform(part, one), "")).otherwise(text)


def clean_html(text: Column) -> Column:
    """Canonical words of a text with character references resolved and tags taken out."""
    return canonical(F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), "<[^>]+>", " "))


def _term_pattern(term: str) -> str:
    return r"(?U)(?<!\w)" + r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in plain(term).split(" ")) + r"(?!\w)"


def matching_terms(normalized: Column, terms: Iterable[str]) -> Column:
    """The terms that stand in the text as whole words or phrases, in the order given."""
    # a text without a term's first word is not matched
    found = [F.when(normalized.contains(plain(t).split(" ")[0]) & normalized.rlike(_term_pattern(t)), F.lit(t)) for t in terms if plain(t)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def has_term(normalized: Column, terms: Iterable[str]) -> Column:
    patterns = [_term_pattern(t) for t in terms if plain(t)]
    return normalized.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def phrases(canonical_text: Column, terms: Iterable[str]) -> Column:
    """The phrases among the words of a canonical text."""
    padded = F.concat(F.lit(" "), canonical_text, F.lit(" "))
    found = [F.when(F.contains(padded, F.lit(f" {t} ")), F.lit(t)) for t in terms if t]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def has_phrase(canonical_text: Column, terms: Iterable[str]) -> Column:
    wanted = [f" {t} " for t in terms if t]
    # the text is computed once, not for every phrase
    return F.exists(F.array(F.concat(F.lit(" "), F.coalesce(canonical_text, F.lit("")), F.lit(" "))), lambda padded: reduce(or_, (F.contains(padded, F.lit(w)) for w in wanted), F.lit(False)))


def near(canonical_text: Column, left: Iterable[str], right: Iterable[str], distance: int) -> Column:
    """Whether a word of ``left`` and one of ``right`` stand at most ``distance`` words apart."""
    words = F.split(canonical_text, " ")
    at = lambda wanted: F.filter(F.transform(words, lambda w, i: F.when(w.isin(*wanted), i)), lambda i: i.isNotNull())
    ls, rs = at(list(left)), at(list(right))
    return F.exists(ls, lambda a: F.exists(rs, lambda b: F.abs(a - b) <= distance))


def within_context(canonical_text: Column, terms: Iterable[str], context: Iterable[str], width: int) -> Column:
    """Whether a phrase of ``context`` lies within ``width`` characters around a phrase of ``terms``.

    The window may cut words at its ends; a cut word counts as one. The text is split at the term,
    and a window is put together from the ends of as many pieces as can reach into it.
    """
    padded = F.concat(F.lit(" "), canonical_text, F.lit(" "))
    wanted = F.array(*(F.lit(f" {c} ") for c in context if c))
    told = lambda w: F.exists(wanted, lambda c: F.contains(w, c))
    result = F.lit(False)
    for term in terms:
        # texts without the term are not split
        result = result | F.contains(padded, F.lit(f" {term} ")) & _any_window(padded, term, width, told)
    return result


def _any_window(padded: Column, term: str, width: int, told) -> Column:
    """Whether a window around the term fulfils ``told``. Arrays of one element hold what inner functions use many times,
    which each of their calls would compute anew."""
    reach = width // (len(term) + 1) + 2
    edge = F.lit(width + 1)
    ends = lambda pieces: F.struct(F.transform(pieces, lambda p: F.left(p, edge)).alias("heads"), F.transform(pieces, lambda p: F.right(p, edge)).alias("tails"))

    def window(e: Column, k: Column) -> Column:
        before = F.array_join(F.slice(e["tails"], F.greatest(F.lit(1), k - reach + 1), F.least(k, F.lit(reach))), term)
        after = F.array_join(F.slice(e["heads"], k + 1, reach), term)
        return F.concat(F.lit(" "), F.right(F.left(before, F.length(before) - 1), F.lit(width)), F.lit(f" {term} "), F.left(F.substr(after, F.lit(2)), F.lit(width)), F.lit(" "))

    places = lambda e: F.when(F.size(e["heads"]) > 1, F.sequence(F.lit(1), F.size(e["heads"]) - 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.array(F.split(padded, f"(?<= ){re.escape(term)}(?= )"))
    return F.exists(F.transform(pieces, ends), lambda e: F.exists(places(e), lambda k: F.exists(F.array(window(e, k)), told)))


def slug(text: Column, separator: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(normalize(text), "[^a-z0-9]+", separator), f"^{separator}+|{separator}+$", "")


def first_match(normalized: Column, rules: Iterable[tuple[str, Iterable[str]]], otherwise: str | None) -> Column:
    """Label of the first rule with a word of which the text has a part."""
    result = F.lit(otherwise)
    for label, parts in reversed(list(rules)):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(normalized, F.lit(part))
        result = F.when(hit, label).otherwise(result)
    return result


#: Words that stand for a workplace, in the order in which they count.
WORKPLACES = (("remote", ("remote", "remoto", "remota", "home office")), ("hybrid", ("hybrid", "hibrido", "hibrida")), ("onsite", ("on-site", "onsite", "presencial")))
#: Words that stand for a kind of employment.
EMPLOYMENTS = (("internship", ("estagi", "intern")), ("trainee", ("trainee",)), ("apprentice", ("aprendiz", "apprentice")), ("full_time", ("efetivo", "clt", "full time", "full-time")), ("temporary", ("temporari", "temporary")))


def workplace(text: Column) -> Column:
    return first_match(normalize(text), WORKPLACES, "unknown")


def employment(text: Column) -> Column:
    return first_match(normalize(text), EMPLOYMENTS, None)


def salary(text: Column) -> Column:
    """First amount written with R$, US$, $ or €, or null."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:R\$|US\$|\$|€)\s*[0-9][0-9.,]*[0-9]|(?:R\$|US\$|\$|€)\s*[0-9]", 0)
    return F.when(found != "", found)
