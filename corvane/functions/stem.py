"""English stems by suffix stripping with measured regions, as a column, as SQL, in plain Python and on Arrow arrays.

The steps are written once, over a few operations on words; ``COLUMN``, ``SQL``,
``PLAIN`` and ``ARROW`` carry them out.  A step names its input, so an expression grows with the
number of steps and not with their product.  Texts have far more words than a
language has: ``stems`` stems a vocabulary once, to be joined back.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The algorithm's suffixes, exceptions and letters (fixed values).
VOWELS, DOUBLES, LI_ENDS = "aeiouy", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", "[cdeghkmnrt]li$"
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
STOPPED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_STARTS = "^(gener|commun|arsen)"
STEP_2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


class _Column:
    text = staticmethod(F.lit)
    matches = staticmethod(lambda w, pattern: w.rlike(pattern))
    replace = staticmethod(lambda w, pattern, by: F.regexp_replace(w, pattern, by))
    cut = staticmethod(lambda w, n: F.substring(w, F.lit(1), F.length(w) - n))
    join = staticmethod(lambda w, end: F.concat(w, F.lit(end)))
    length = staticmethod(F.length)
    one_of = staticmethod(lambda w, words: w.isin(*words))
    ends = staticmethod(lambda w, end: F.endswith(w, F.lit(end)))
    let = staticmethod(lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0)))
    both = staticmethod(lambda a, b: a & b)
    either = staticmethod(lambda a, b: a | b)
    no = staticmethod(lambda a: ~a)
    at_least = staticmethod(lambda a, b: a >= b)

    @staticmethod
    def when(cases: list[tuple[Any, Any]], other: Any) -> Column:
        return reduce(lambda acc, c: acc.when(*c), cases, F).otherwise(other)


class _Sql:
    """Operations as SQL text; names of bound values are numbered."""

    count = 0
    text = staticmethod(lambda s: f"'{s}'")
    matches = staticmethod(lambda w, pattern: f"regexp_matches({w}, '{pattern}')")
    replace = staticmethod(lambda w, pattern, by: f"regexp_replace({w}, '{pattern}', '{by.replace('$', chr(92))}')")
    cut = staticmethod(lambda w, n: f"substr({w}, 1, length({w}) - {n})")
    join = staticmethod(lambda w, end: f"({w} || '{end}')")
    length = staticmethod(lambda w: f"length({w})")
    one_of = staticmethod(lambda w, words: f"({w} IN ({', '.join(repr(x) for x in words)}))")
    ends = staticmethod(lambda w, end: f"ends_with({w}, '{end}')")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    either = staticmethod(lambda a, b: f"({a} OR {b})")
    no = staticmethod(lambda a: f"(NOT {a})")
    at_least = staticmethod(lambda a, b: f"({a} >= {b})")

    @classmethod
    def let(cls, value: str, use: Callable) -> str:
        cls.count += 1
        name = f"v{cls.count}"
        return f"list_transform([{value}], lambda {name}: {use(name)})[1]"

    @staticmethod
    def when(cases: list[tuple[str, str]], other: str) -> str:
        return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {other} END)"


class _Plain:
    """Operations on Python strings; a case is only worked out if those before it do not hold."""

    text = staticmethod(lambda s: s)
    matches = staticmethod(lambda w, pattern: re.search(pattern, w) is not None)
    replace = staticmethod(lambda w, pattern, by: re.sub(pattern, by.replace("$", "\\"), w))
    cut = staticmethod(lambda w, n: w[: max(0, len(w) - n)])
    join = staticmethod(lambda w, end: w + end)
    length = staticmethod(len)
    one_of = staticmethod(lambda w, words: w in words)
    ends = staticmethod(lambda w, end: w.endswith(end))
    let = staticmethod(lambda value, use: use(value))
    both = staticmethod(lambda a, b: a and b)
    either = staticmethod(lambda a, b: a or b)
    no = staticmethod(lambda a: not a)
    at_least = staticmethod(lambda a, b: a >= b)
    when = staticmethod(lambda cases, other: next((v for c, v in cases if c), other))


class _Arrow:
    """Operations on whole Arrow arrays of words; conditions and lengths are numpy arrays."""

    text = staticmethod(pa.scalar)
    matches = staticmethod(lambda w, pattern: pc.match_substring_regex(w, pattern).to_numpy(zero_copy_only=False))
    replace = staticmethod(lambda w, pattern, by: pc.replace_substring_regex(w, pattern, by.replace("$", "\\")))
    cut = staticmethod(lambda w, n: pc.utf8_slice_codeunits(w, 0, -n))
    join = staticmethod(lambda w, end: pc.binary_join_element_wise(w, end, ""))
    length = staticmethod(lambda w: pc.utf8_length(w).to_numpy(zero_copy_only=False).astype(np.int64))
    one_of = staticmethod(lambda w, words: pc.is_in(w, pa.array(words)).to_numpy(zero_copy_only=False))
    ends = staticmethod(lambda w, end: pc.ends_with(w, end).to_numpy(zero_copy_only=False))
    let = staticmethod(lambda value, use: use(value))
    both = staticmethod(lambda a, b: a & b)
    either = staticmethod(lambda a, b: a | b)
    no = staticmethod(lambda a: ~a)
    at_least = staticmethod(lambda a, b: a >= b)

    @staticmethod
    def when(cases: list[tuple[Any, Any]], other: Any) -> Any:
        choose = np.where if isinstance(other, np.ndarray) else (lambda c, v, w: pc.if_else(pa.array(c), v, w))
        return reduce(lambda out, case: choose(*case, out) if case[0].any() else out, reversed(cases), other)


COLUMN, SQL, PLAIN, ARROW = _Column, _Sql, _Plain, _Arrow
_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
#: Up to the end of the first non-vowel behind a vowel.
_TO_REGION = f"^.*?{_V}{_C}"
#: A short syllable at the end of a word.
_SHORT = f"(^{_V}{_C}|{_C}{_V}[^{VOWELS}wxY])$"


def stem(o: Any, word: Any) -> Any:
    """The stem of a lower-case word of letters and digits, with the operations ``o``."""

    def inside(w: Any, suffix: str, region: Any) -> Any:
        """Does the suffix, with which w ends, lie in the region that starts behind so many letters?"""
        return o.at_least(o.length(w), region + len(suffix) if not isinstance(region, str) else f"({region} + {len(suffix)})")

    def longest(w: Any, suffixes: dict[str, str], region: Any) -> list[tuple[Any, Any]]:
        """Cases for the longest suffix that w has: replaced if it lies in the region, else nothing is done."""
        out = []
        for suffix in sorted(suffixes, key=lambda s: (-len(s), s)):
            done = o.join(o.cut(w, len(suffix)), suffixes[suffix]) if suffixes[suffix] else o.cut(w, len(suffix))
            out += [(o.both(o.ends(w, suffix), inside(w, suffix, region)), done), (o.ends(w, suffix), w)]
        return out

    def step_1a(w: Any) -> Any:
        return o.when(
            [(o.ends(w, "sses"), o.cut(w, 2)), (o.matches(w, "^..+ie[ds]$"), o.cut(w, 2)), (o.matches(w, "^.ie[ds]$"), o.cut(w, 1)), (o.matches(w, "(us|ss)$"), w), (o.matches(w, f"{_V}.+s$"), o.cut(w, 1))], w
        )

    def short(w: Any, region: Any) -> Any:
        return o.both(o.no(o.at_least(o.length(w), region + 1 if not isinstance(region, str) else f"({region} + 1)")), o.matches(w, _SHORT))

    def mended(w: Any, region: Any) -> Any:
        return o.when([(o.matches(w, "(at|bl|iz)$"), o.join(w, "e")), (o.matches(w, DOUBLES), o.cut(w, 1)), (short(w, region), o.join(w, "e"))], w)

    def step_1b(w: Any, region: Any) -> Any:
        cases = []
        for suffix in ("eedly", "eed"):
            cases += [(o.both(o.ends(w, suffix), inside(w, suffix, region)), o.cut(w, len(suffix) - 2)), (o.ends(w, suffix), w)]
        for suffix in ("ingly", "edly", "ing", "ed"):
            cases += [(o.matches(w, f"{_V}.*{suffix}$"), o.let(o.cut(w, len(suffix)), lambda x: mended(x, region))), (o.ends(w, suffix), w)]
        return o.when(cases, w)

    def step_2(w: Any, r1: Any) -> Any:
        ogi, li = inside(w, "ogi", r1), inside(w, "li", r1)
        return o.when([*longest(w, STEP_2, r1), (o.both(o.ends(w, "logi"), ogi), o.cut(w, 1)), (o.ends(w, "ogi"), w), (o.both(o.matches(w, LI_ENDS), li), o.cut(w, 2))], w)

    def step_3(w: Any, r1: Any, r2: Any) -> Any:
        return o.when([*longest(w, STEP_3, r1), (o.both(o.ends(w, "ative"), inside(w, "ative", r2)), o.cut(w, 5))], w)

    def step_4(w: Any, r2: Any) -> Any:
        return o.when([*longest(w, dict.fromkeys(STEP_4, ""), r2), (o.both(o.matches(w, "[st]ion$"), inside(w, "ion", r2)), o.cut(w, 3))], w)

    def step_5(w: Any, r1: Any, r2: Any) -> Any:
        gone = o.either(inside(w, "e", r2), o.both(inside(w, "e", r1), o.no(o.matches(w, f"(^{_V}{_C}|{_C}{_V}[^{VOWELS}wxY])e$"))))
        return o.when([(o.both(o.ends(w, "e"), gone), o.cut(w, 1)), (o.both(o.ends(w, "ll"), inside(w, "l", r2)), o.cut(w, 1))], w)

    def last(w: Any, r1: Any, r2: Any) -> Any:
        """All steps behind the exceptions of step 1a."""
        one = o.let(step_1b(w, r1), lambda x: o.replace(x, "^(.+[^aeiouy])[yY]$", "$1i"))
        return o.let(o.let(o.let(o.let(one, lambda x: step_2(x, r1)), lambda x: step_3(x, r1, r2)), lambda x: step_4(x, r2)), lambda x: step_5(x, r1, r2))

    def rest(w: Any) -> Any:
        def start(x: Any, pattern: str, none: Any) -> Any:
            """Letters up to the end of the pattern's match; all of them without one."""
            return o.when([(o.matches(x, pattern), o.length(x) - o.length(o.replace(x, pattern, "")) if o is not SQL else f"(length({x}) - length({o.replace(x, pattern, '')}))")], none)

        r1 = o.when([(o.matches(w, REGION_STARTS), start(w, REGION_STARTS, o.length(w)))], start(w, _TO_REGION, o.length(w)))

        def second(r: Any) -> Any:
            """The second region starts as the first one does, within it."""
            tail = o.let(_after(o, w, r), lambda x: start(x, _TO_REGION, o.length(x)))
            return r + tail if o is not SQL else f"({r} + {tail})"

        def regions(r: Any) -> Any:
            return o.let(second(r), lambda r2: o.let(step_1a(w), lambda x: o.when([(o.one_of(x, STOPPED), x)], last(x, r, r2))))

        return o.let(r1, regions)

    def marked(w: Any) -> Any:
        """A y at the start or behind a vowel is no vowel."""
        return o.replace(o.replace(w, "^y", "Y"), "([aeiouy])y", "$1Y") if o is not SQL else f"regexp_replace(regexp_replace({w}, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"

    lower = F.lower if o is COLUMN else pc.utf8_lower if o is ARROW else (lambda x: f"lower({x})") if o is SQL else str.lower
    special = [(o.one_of(word, (k,)), o.text(v)) for k, v in SPECIAL.items()]
    return o.when([(o.no(o.at_least(o.length(word), 3)), word), (o.one_of(word, UNCHANGED), word), *special], lower(o.let(marked(word), rest)))


def _after(o: Any, w: Any, n: Any) -> Any:
    """What follows the first n letters."""
    if o is ARROW:
        return pa.array([x[k:] for x, k in zip(w.to_pylist(), n.tolist())], pa.string())
    return w[n:] if o is PLAIN else f"substr({w}, {n} + 1)" if o is SQL else F.substring(w, n + 1, F.length(w))


def stem_column(word: Column) -> Column:
    return stem(COLUMN, word)


def stem_sql(word: str) -> str:
    return stem(SQL, word)


def stem_word(word: str) -> str:
    return stem(PLAIN, word)


#: Words that end otherwise have no suffix and are their own stems.
_ENDINGS = "[scdegilmnrty]$"


def stem_array(words: pa.Array) -> pa.Array:
    """The stems of many words (without nulls) at once."""
    ends = pc.match_substring_regex(words, _ENDINGS)
    return pc.replace_with_mask(words, ends, stem(ARROW, words.filter(ends)))


def stems(words: DataFrame) -> DataFrame:
    """(word, lexeme) of every distinct word."""
    return words.select("word").where("word is not null").distinct().select("word", F.transform(F.array("word"), stem_column)[0].alias("lexeme"))
