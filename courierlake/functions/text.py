"""Folding, tokens, grams and the query syntax of full-text search, as native columns.

A text is indexed as its sequence of tokens: runs of letters and digits outside CJK scripts are words, CJK
characters are tokens of their own. A query term that gives several tokens is a phrase, so a CJK term
matches as a substring. Trigrams serve the fuzzy layer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points of Han ideographs, kana and Hangul, without CJK punctuation.
CJK_RANGES = (
    (0x1100, 0x11FF), (0x3005, 0x3007), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF),
    (0x3131, 0x318E), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7A3),
    (0xD7B0, 0xD7FF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0xFFA0, 0xFFDC), (0x20000, 0x3FFFF),
)
#: What lower-case letters of other scripts fold to, and Latin letters that fold to two.
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n",
    "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ы": "y",
    "ь": "'", "э": "e", "ю": "iu", "я": "ia", "ё": "io", "ђ": "dj", "ѓ": "gj", "є": "ie", "ѕ": "dz", "і": "i", "ї": "yi", "ј": "j", "љ": "lj", "њ": "nj",
    "ћ": "tsh", "ќ": "kj", "ў": "u", "џ": "dzh", "ґ": "g",
}
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
#: Letters that fold to several.
SEVERAL = {a: b for a, b in (LATIN | GREEK | CYRILLIC).items() if len(b) > 1}
#: Words of this length and more are no tokens.
LONGEST = 41
_CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)
_PY_CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
TOKEN = f"[{_CJK}]|[\\p{{L}}\\p{{N}}&&[^{_CJK}]]+"


def _singles() -> tuple[str, str]:
    """Lower-case letters that fold to one, and what they fold to: letters with marks by Unicode's decompositions."""
    pairs = {"ø": "o", "đ": "d", "ł": "l", "ð": "d", "ħ": "h", "ı": "i", "ŧ": "t"} | {a: b for a, b in (GREEK | CYRILLIC).items() if len(b) == 1}
    for i in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and chr(i) not in pairs | SEVERAL and chr(i).lower() == chr(i) and (base[0].isascii() or base[0] in pairs):
            pairs[chr(i)] = pairs.get(base[0], base[0])
    return "".join(pairs), "".join(pairs.values())


FROM, TO = _singles()


def fold_singles(x: Column) -> Column:
    """Lower case without accents; keeps the number of characters."""
    return F.translate(F.lower(x), FROM, TO)


#: Texts that hold a letter which folds to several.
_SEVERAL = "[" + "".join(SEVERAL) + "]"


def _all_replaced(x: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _spelt_out(x: Column) -> Column:
    """``x`` with letters that fold to several spelt out; only texts that hold one are looked through for each."""
    other = {a: b for a, b in SEVERAL.items() if a not in LATIN}
    return F.when(x.rlike("[" + "".join(other) + "]"), _all_replaced(_all_replaced(x, other), LATIN)).otherwise(_all_replaced(x, LATIN))


def fold(x: Column) -> Column:
    """Lower case without accents; ß, æ and the like become two letters, Greek and Cyrillic ones become Latin."""
    return _spelt_out(F.regexp_replace(fold_singles(x), r"\p{Mn}", ""))


def _spelt_out_py(s: str) -> str:
    return "".join(SEVERAL.get(c, c) for c in s)


def fold_py(s: str) -> str:
    out = unicodedata.normalize("NFC", s).lower().translate(str.maketrans(FROM, TO))
    return "".join(c for c in _spelt_out_py(out) if unicodedata.category(c) != "Mn")


def let(x: Column, f) -> Column:
    """``f`` of a value that is computed once for a row, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def tokens(x: Column) -> Column:
    """The tokens of a text in order: folded words of up to 40 characters, and CJK characters."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.when(F.length(t) < LONGEST, fold(t)).otherwise("")), lambda t: t != "")


def cjk_grams(x: Column) -> Column:
    """``(pos, token)`` of a text: words at their place; a CJK character and, at the same place, the pair it
    begins."""
    at = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), F.lit(0))
    whole = F.coalesce(x, F.lit(""))
    one = F.transform(tokens(x), lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
    pair = F.transform(at, lambda t, i: F.struct(i.alias("pos"), F.concat(t, F.coalesce(F.try_element_at(at, i + 2), F.lit(""))).alias("token")))
    pair = F.filter(pair, lambda p: p["token"].rlike(f"^[{_CJK}]{{2}}$") & whole.contains(p["token"]))
    return F.array_sort(F.concat(one, pair))


def sequence_text(x: Column) -> Column:
    """The tokens joined and framed by spaces, in which a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens(x), " "), F.lit(" "))


def query_tokens(term: str) -> list[str]:
    found = re.findall(f"[{_PY_CJK}]|[^\\W_{_PY_CJK}]+", term)
    return [f for t in found if len(t) < LONGEST and (f := fold_py(t))]


def has_phrase(seq: Column, term: str) -> Column:
    """Whether the tokens of ``term`` follow each other in ``seq`` (``sequence_text``). No token matches nothing."""
    words = query_tokens(term)
    return seq.contains(" " + " ".join(words) + " ") if words else F.lit(False)


def windows(x: Column, distinct: bool = False) -> Column:
    """The folded windows of three characters over the whole text, spaces included; or each of them once."""

    def of(chars: Column) -> Column:
        n = F.size(chars)
        out = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
        out = F.array_distinct(out) if distinct else out
        return F.when(n >= 3, out).otherwise(F.array().cast("array<string>"))

    def spelt_out(text: Column) -> Column:
        found = let(F.split(text, ""), of)
        return F.when(text.rlike(_SEVERAL), F.transform(found, _spelt_out)).otherwise(found)

    return let(fold_singles(F.coalesce(x, F.lit(""))), spelt_out)  # once for a text: its work grows with its length


def grams(x: Column) -> Column:
    """The distinct folded windows of three characters over the whole text, spaces included."""
    return windows(x, True)


def query_grams(term: str) -> list[str]:
    """The grams of a query term in order; none for short terms and those with CJK characters."""
    s = unicodedata.normalize("NFC", term).lower().translate(str.maketrans(FROM, TO))
    if len(s) < 3 or re.search(f"[{_PY_CJK}]", s):
        return []
    return [_spelt_out_py(s[i : i + 3]) for i in range(len(s) - 2)]


def gram_spellings(gram: str, chars: int = 3) -> list[str]:
    """The stretches of ``chars`` characters that are spelt out as ``gram``: itself, and others where letters fold to several."""
    if not chars:
        return [] if gram else [""]
    ends = [(c, len(b)) for c, b in SEVERAL.items() if gram.startswith(b)] + [(gram[:1], 1)] * (gram[:1] not in SEVERAL)
    return [c + rest for c, n in ends if c for rest in gram_spellings(gram[n:], chars - 1)]


def gram_text(x: Column) -> Column:
    """The text in which ``grams_match`` looks for grams: one is among a text's windows just if this contains one of its spellings."""
    return fold_singles(F.coalesce(x, F.lit("")))


def enough_grams(term: str, has) -> Column:
    """All grams of the term are there by ``has``, or, of three and more, all but one that the term has once."""
    q = query_grams(term)
    if not q:
        return F.lit(False)
    lost = {g: (~has(g)).cast("int") for g in dict.fromkeys(q)}
    missing = sum(lost.values(), F.lit(0))
    once = [lost[g] for g in lost if q.count(g) == 1]
    if len(q) < 3 or not once:
        return missing == 0
    return (missing == 0) | ((missing == 1) & (sum(once, F.lit(0)) == 1))


def grams_match(doc: Column, term: str) -> Column:
    """``enough_grams`` of a term in ``doc`` (``gram_text``); no array of windows is built."""

    def has(gram: str) -> Column:
        out = F.lit(False)
        for g in gram_spellings(gram):
            out = out | doc.contains(g)
        return out

    return enough_grams(term, has)


def fuzzy_match(docs: list[Column], text: str) -> Column:
    """Each term's grams are in one of the fields. A term without grams turns the layer off; excluded terms and
    quotes play no part here."""
    terms = fuzzy_terms(text)
    out = F.lit(bool(terms))
    for t in terms:
        any_field = F.lit(False)
        for d in docs:
            any_field = any_field | grams_match(d, t)
        out = out & any_field
    return out


@dataclass(frozen=True)
class Clause:
    """A term or phrase of a query, whether it is excluded, the only field it asks (or None), whether other words may begin with it,
    how much it weighs, and the bounds of a range (both inclusive; None is open)."""

    text: str
    excluded: bool = False
    field: str | None = None
    prefix: bool = False
    boost: float = 1.0
    bounds: tuple[str | None, str | None] | None = None


_CLAUSE = re.compile(r"""([-+]?)(?:([A-Za-z_]\w*):)?(?:\[(\S+)\s+TO\s+(\S+)\]|"([^"]*)"|([^\s"]\S*?))(\*?)(?:\^(\d+(?:\.\d+)?))?(?=\s|$)""")


def clauses(query: str, named: Collection[str] = ()) -> list[list[Clause]]:
    """A query as alternatives (``OR``) of clauses that all hold: words, ``"phrases"``, ``-excluded`` ones, ``word*``, ``word^2``, and for the
    fields in ``named`` ``field:word`` and ``field:[low TO high]``, where ``*`` is an open end. What names no such field is a term as it stands."""
    out: list[list[Clause]] = [[]]
    for m in _CLAUSE.finditer(query):
        minus, name, low, high, quoted, word, star, boost = m.groups()
        if word == "OR" and not (minus or name):
            out.append([])
            continue
        text = quoted if quoted is not None else word or ""
        if name and name not in named:
            name, text, low, high = None, m.group(0)[len(minus):].rstrip("*"), None, None
        if low is not None and name:
            out[-1].append(Clause("", minus == "-", name, bounds=tuple(None if x == "*" else x for x in (low, high))))
        elif text and not (word == "AND" and not (minus or name)):
            out[-1].append(Clause(text, minus == "-", name, bool(star), float(boost or 1)))
    return [c for c in out if c]


def has_prefix(seq: Column, term: str) -> Column:
    """Whether the tokens of ``term`` follow each other in ``seq``, of which the last may go on."""
    words = query_tokens(term)
    return seq.contains(" " + " ".join(words)) if words else F.lit(False)


def in_bounds(x: Column, low: str | None, high: str | None, kind: str) -> Column:
    """Whether a value lies between two bounds, which are read as the column's own type."""
    out = x.isNotNull()
    if low is not None:
        out = out & (x >= F.lit(low).cast(kind))
    return out & (x <= F.lit(high).cast(kind)) if high is not None else out


def word_match(fields: list[Column], query: str, named: dict[str, Column] | None = None, ranges: dict[str, tuple[Column, str]] | None = None) -> Column:
    """The query over ``sequence_text`` fields: a clause holds if one field has it, or the one it names in ``named``; a range looks at the value
    (and its type) in ``ranges``. An alternative of excluded clauses alone matches nothing, like an empty query."""
    named, ranges = named or {}, ranges or {}
    out = F.lit(False)
    for part in clauses(query, [*named, *ranges]):
        if all(c.excluded for c in part):
            continue
        every = F.lit(True)
        for c in part:
            hit = F.lit(False)
            if c.bounds:
                value, kind = ranges.get(c.field, (None, ""))
                hit = hit if value is None else in_bounds(value, *c.bounds, kind)
            else:
                for f in [named[c.field]] if c.field in named else [] if c.field else fields:
                    hit = hit | (has_prefix(f, c.text) if c.prefix else has_phrase(f, c.text))
            every = every & (~hit if c.excluded else hit)
        out = out | every
    return out


def fuzzy_terms(text: str) -> list[str]:
    """The terms of the fuzzy layer; none if one of them has no grams, which turns the layer off."""
    terms = [t.strip('"') for t in text.split() if not t.startswith("-")]
    return terms if all(query_grams(t) for t in terms) else []


def facet_prefixes(tags: Column) -> Column:
    """Every ancestor of each path, and the path: ``/a/b`` gives ``/a`` and ``/a/b``."""
    def up(path: Column) -> Column:
        parts = F.split(F.substring(path, 2, 1_000_000), "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))

    return F.array_distinct(F.flatten(F.transform(F.coalesce(tags, F.array().cast("array<string>")), up)))
