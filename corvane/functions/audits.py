"""Checks of written abstracts against their sources, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SEPARATOR

#: Abbreviations whose period ends no sentence (fixed values).
ABBREVIATIONS = ("e.g.", "i.e.", "cf.", "vs.", "al.", "viz.", "approx.", "esp.", "dr.", "mr.", "mrs.", "ms.", "st.", "fig.", "no.")
#: Words that make a count inexact (fixed values).
INEXACT = ("to", "or", "than", "least", "most", "about", "approximately", "roughly", "around", "nearly", "over", "under", "almost", "some")
_UNITS = dict(zip("one two three four five six seven eight nine".split(), range(1, 10)))
_TEENS = dict(zip("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(10, 20)))
_TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))
#: What may stand between the end of a sentence and the space after it (a fixed value).
_CLOSERS = "[\"'\\)\\]”]*"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _stretches(plain: Column) -> Column:
    """Stretches of a text up to an end mark each."""
    return F.regexp_extract_all(plain, F.lit(rf"(?s)(.*?[.!?]{_CLOSERS}(?=\s|$))"), 1)


def _ends(pieces: Column) -> Column:
    """For each stretch the number of them up to it where a sentence ends there, else 0."""
    token = lambda p: F.lower(F.regexp_extract(p, rf"(\S*\.){_CLOSERS}$", 1))
    marker = lambda p, k: F.when(k == 0, p.rlike(rf"(?s)(^|\n)[ \t]*\d{{1,3}}\.{_CLOSERS}$")).otherwise(p.rlike(rf"(?s)\n[ \t]*\d{{1,3}}\.{_CLOSERS}$"))
    return F.transform(pieces, lambda p, k: F.when(token(p).isin(*ABBREVIATIONS) | marker(p, k), 0).otherwise(k + 1))


def trimmed_to_sentence(text: Column) -> Column:
    """Text to its last whole sentence; all of it, stripped, if no sentence ends in it.

    A period of an abbreviation, or of a number that starts a line, ends no sentence.
    """
    def of(plain: Column) -> Column:
        return _let(_stretches(plain), lambda pieces: _let(F.array_max(_ends(pieces)), lambda last: F.when(F.coalesce(last, F.lit(0)) > 0, F.array_join(F.slice(pieces, 1, last), "")).otherwise(plain)))

    return _let(_stripped(text), of)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "’‐‑–—", "'----")), r"[\s-]+", " "))


def acronym_glosses(abstract: Column, source: Column) -> Column:
    """Array of (acronym, expansion) that an abstract claims and its source does not say.

    A claim is ``ACR (words)`` or ``words (ACR)`` whose initials are the acronym's letters;
    a plural or singular end of the last word makes no difference.
    """
    initials = lambda words: F.array_join(F.transform(F.split(_normal(words), " "), lambda w: F.substring(w, 1, 1)), "")
    pair = lambda acronym, words: F.struct(acronym.alias("acronym"), words.alias("expansion"))
    after = F.transform(F.regexp_extract_all(abstract, F.lit(r"(\b[A-Z]{2,10}\s*\([A-Za-z][^()]*\))"), 1), lambda s: pair(F.regexp_extract(s, "^([A-Z]+)", 1), F.regexp_extract(s, r"\(([^()]*)\)", 1)))
    before = F.transform(
        F.regexp_extract_all(abstract, F.lit(r"((?:[A-Za-z][\w'-]*\s+){1,10}\([A-Z]{2,10}\))"), 1),
        lambda s: pair(F.regexp_extract(s, r"\(([A-Z]+)\)$", 1), F.array_join(F.slice(F.split(F.trim(F.regexp_replace(s, r"\([A-Z]+\)$", "")), r"\s+"), -F.least(F.length(F.regexp_extract(s, r"\(([A-Z]+)\)$", 1)), F.size(F.split(F.trim(F.regexp_replace(s, r"\([A-Z]+\)$", "")), r"\s+"))), F.length(F.regexp_extract(s, r"\(([A-Z]+)\)$", 1))), " ")),
    )
    said = F.concat(F.lit(" "), _normal(F.regexp_replace(F.coalesce(source, F.lit("")), r"[^\w\s'-]", " ")), F.lit(" "))
    one = lambda words: F.regexp_replace(_normal(words), "s$", "")
    attested = lambda words: said.contains(F.concat(F.lit(" "), one(words), F.lit(" "))) | said.contains(F.concat(F.lit(" "), one(words), F.lit("s ")))
    return F.array_distinct(F.filter(F.concat(after, before), lambda g: (initials(g["expansion"]) == F.lower(g["acronym"])) & ~attested(g["expansion"])))


def without_glosses(abstract: Column, glosses: Column) -> Column:
    """The abstract with each claim of ``glosses`` replaced by its acronym."""
    return F.aggregate(glosses, abstract, lambda text, g: F.replace(F.replace(text, F.concat(g["acronym"], F.lit(" ("), g["expansion"], F.lit(")")), g["acronym"]), F.concat(g["expansion"], F.lit(" ("), g["acronym"], F.lit(")")), g["acronym"]))


def _words(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _value(word: Column) -> Column:
    """The number that a token says alone: digits, or a number word up to ninety-nine."""
    table = {**_UNITS, **_TEENS, **_TENS, **{f"{t}-{u}": a + b for t, a in _TENS.items() for u, b in _UNITS.items()}}
    return F.coalesce(word.try_cast("int"), F.element_at(_words(table), word))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numbers_at(tokens: Column) -> Column:
    """For each token the (value, first) of the number, up to 999, that ends with it, or NULL; ``first`` is the place of its first token.

    ``six hundred and twenty-one``, ``six hundred``, ``twenty one`` and ``621`` are numbers.
    """
    number = lambda value, first: F.struct(value.cast("int").alias("value"), first.cast("int").alias("first"))

    def ends(units: Column, small: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            here = F.get(small, i)
            before = here["first"] - 1
            unit = lambda k: F.get(units, k)
            joined, plain = (F.get(tokens, before) == "and") & (F.get(tokens, before - 1) == "hundred"), F.get(tokens, before) == "hundred"
            words = ~w.rlike("^[0-9]+$")
            return (
                F.when((w == "hundred") & unit(i - 1).isNotNull(), number(100 * unit(i - 1), i - 1)).when(words & joined & unit(before - 2).isNotNull(), number(here["value"] + 100 * unit(before - 2), before - 2))
                .when(words & plain & unit(before - 1).isNotNull(), number(here["value"] + 100 * unit(before - 1), before - 1)).otherwise(here)
            )

        return F.transform(tokens, one)

    def small(units: Column) -> Column:
        tens = lambda i: F.element_at(_words(_TENS), F.coalesce(F.get(tokens, i), F.lit("")))
        return F.transform(tokens, lambda w, i: F.when(tens(i - 1).isNotNull() & F.get(units, i).isNotNull(), number(tens(i - 1) + F.get(units, i), i - 1)).when(_value(w).isNotNull(), number(_value(w), i)))

    return _let(F.transform(tokens, lambda w: F.element_at(_words(_UNITS), w)), lambda units: _let(small(units), lambda some: ends(units, some)))


def turn_claims(abstract: Column, source: Column) -> Column:
    """Array of (surface, value, derived, attested) of exact turn counts that the source's turn headings contradict, or that it never says.

    A source without turn headings makes no claim false; a claim behind another number or
    a word like ``about`` is not exact, and ``one turns`` is a verb.  Numbers go to 999.
    """
    strip = lambda c: F.filter(F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"^['\"().,;:!?\[\]]+|['\"().,;:!?\[\]]+$", "")), lambda w: w != "")
    derived = F.size(F.regexp_extract_all(source, F.lit(r"(?im)^\s{0,3}#{1,6}\s+(turn)\s+\d+\b"), 1))
    spoken = F.filter(F.split(F.lower(source), r"[^\w-]+"), lambda w: w != "")
    said = F.transform(F.array_compact(_let(spoken, numbers_at)), lambda x: x["value"])

    def claims(tokens: Column, numbers: Column, said: Column) -> Column:
        def claim(w: Column, k: Column) -> Column:
            own = F.get(numbers, k - 1)
            before = own["first"] - 1
            exact = F.coalesce(F.get(numbers, before).isNull() & ~F.get(tokens, before).isin(*INEXACT), F.lit(True)) & ((own["value"] == 1) == (w == "turn"))
            surface = F.array_join(F.slice(tokens, own["first"] + 1, k - own["first"] + 1), " ")
            made = F.struct(surface.alias("surface"), own["value"].alias("value"), derived.alias("derived"), F.array_contains(said, own["value"]).alias("attested"))
            return F.when(w.isin("turn", "turns") & own.isNotNull() & exact & ((own["value"] != derived) | ~F.array_contains(said, own["value"])), made)

        return F.array_distinct(F.array_compact(F.transform(tokens, claim)))

    found = _let(strip(abstract), lambda tokens: _let(numbers_at(tokens), lambda numbers: _let(said, lambda known: claims(tokens, numbers, known))))
    none = F.array().cast("array<struct<surface: string, value: int, derived: int, attested: boolean>>")
    return F.when(derived > 0, F.coalesce(found, none)).otherwise(none)


#: Subjects of an opener that only says what type a document is, its verbs (some with ``as``), words that end what the
#: verb says, the marks at a word's edges, and types that are also spelled out (fixed values).
SUBJECTS = ("document", "text", "file")
VERBS, VERBS_AS = ("is", "constitutes", "represents", "describes"), ("serves", "acts", "functions")
BREAKS = ("of", "for", "to", "in", "on", "at", "by", "with", "from", "about", "across", "between", "within", "and", "or")
EDGES = r"'\"().,;:!?\[\]“”‘’"
SPELLED = {"adr": "architecture decision record"}


def type_opener(abstract: Column, doc_type: Column, window: int = 6) -> Column:
    """(verb, surface) where the first sentence classifies: ``This document is a <type>``; NULL otherwise.

    Its subject is this or the document, text or file; one of the verbs follows somewhere,
    and the type's words start within ``window`` words of it with no connecting word
    before them.  A number may follow the last of them behind a hyphen.
    """
    place = _let(first_sentence(abstract), lambda first: _opener_place(first, doc_type, window))
    return _let(place, lambda p: F.when(p.isNotNull(), F.struct(p["verb"].alias("verb"), p["surface"].alias("surface"))))


def _opener_place(first: Column, doc_type: Column, window: int = 6) -> Column:
    """``type_opener`` of a first sentence with the words' places: (verb, surface, at, first, words), the verb's, the type's first and how many; words without letters do not count."""
    words = F.filter(F.transform(F.split(first, r"\s+"), lambda w: F.regexp_replace(w, rf"^[{EDGES}]+|[{EDGES}]+$", "")), lambda w: w != "")
    return _let(words, lambda said: _let(F.transform(said, F.lower), lambda low: _classified(said, low, doc_type, window)))


def _classified(said: Column, low: Column, doc_type: Column, window: int) -> Column:
    word = lambda k: F.get(low, k)
    plain = F.regexp_replace(F.regexp_replace(F.lower(doc_type), "_+", " "), "^ | $", "")
    spelled = F.element_at(F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair]), F.lower(doc_type))
    typed = lambda words: F.struct(words.alias("words"), F.size(F.split(words, " ")).alias("n"))
    pair = lambda k: word(k).isin(*VERBS_AS) & (word(k + 1) == "as")
    after = lambda k: F.when(F.coalesce(pair(k), F.lit(False)), k + 2).otherwise(k + 1)

    def stands(k: Column, t: Column) -> Column:
        return (k + t["n"] <= F.size(low)) & (F.regexp_replace(F.array_join(F.slice(low, k + 1, t["n"]), " "), r"-\d+$", "") == t["words"])

    def complement(start: Column, own: Column, other: Column) -> Column:
        """(first word, words) of the type after a verb that ends before ``start``."""
        near = F.filter(F.sequence(start, start + window - 1), lambda k: k < F.size(low))
        before = lambda near: _let(F.coalesce(F.array_min(F.filter(near, lambda k: word(k).isin(*BREAKS))), F.lit(1 << 30)), lambda ends: F.filter(near, lambda k: k < ends))
        first = lambda near, t: F.array_min(F.filter(near, lambda k: stands(k, t)))
        either = lambda at: F.when(at["own"].isNotNull() & (at["other"].isNull() | (at["own"] <= at["other"])), F.struct(at["own"].alias("k"), own["n"].alias("n"))).when(at["other"].isNotNull(), F.struct(at["other"].alias("k"), other["n"].alias("n")))
        return _let(_let(near, before), lambda some: _let(F.struct(first(some, own).alias("own"), first(some, other).alias("other")), either))

    def found(own: Column, other: Column) -> Column:
        verbs = F.filter(F.sequence(F.lit(2), F.greatest(F.size(low) - 1, F.lit(2))), lambda k: F.coalesce(word(k).isin(*VERBS) | pair(k), F.lit(False)))
        ends = F.transform(verbs, lambda k: F.struct(k.alias("at"), after(k).alias("end")))
        made = F.transform(ends, lambda v: F.struct(v["at"].alias("at"), F.array_join(F.slice(low, v["at"] + 1, v["end"] - v["at"]), " ").alias("verb"), complement(v["end"], own, other).alias("c")))
        return _let(F.get(F.filter(made, lambda f: f["c"].isNotNull()), F.lit(0)), lambda hit: result(hit, own))

    def result(hit: Column, own: Column) -> Column:
        surface = F.array_join(F.slice(said, hit["c"]["k"] + 1, hit["c"]["n"]), " ")
        return F.when((own["words"] != "") & hit.isNotNull(), F.struct(hit["verb"].alias("verb"), surface.alias("surface"), hit["at"].alias("at"), hit["c"]["k"].alias("first"), hit["c"]["n"].alias("words")))

    frame = word(F.lit(0)).isin("this", "the") & word(F.lit(1)).isin(*SUBJECTS)
    return F.when(frame, _let(typed(plain), lambda own: _let(typed(spelled), lambda other: found(own, other))))


def first_sentence(text: Column) -> Column:
    """The stripped text's first sentence, all of it if none ends."""
    def of(plain: Column) -> Column:
        return _let(_stretches(plain), lambda pieces: _let(F.array_min(F.filter(_ends(pieces), lambda e: e > 0)), lambda first: F.when(first.isNotNull(), F.array_join(F.slice(pieces, 1, first), "")).otherwise(plain)))

    return _let(_stripped(text), of)


#: Words that start a clause about the type (fixed values).
RELATIVES = ("that", "which")


def without_type_opener(abstract: Column, doc_type: Column) -> Column:
    """The abstract with ``is a <type> that`` cut out of its first sentence: ``This document is a report that lists x`` becomes ``This document lists x``.

    Only where that or which, bare, stands right behind the type, or behind one word in brackets after it; any other
    abstract stays as it is, as do one without an opener and one of which nothing would be left.  What is before the
    verb and behind the relative word keeps every character.
    """
    def cut(first: Column, found: Column) -> Column:
        # Words with the space behind them; put together again they are the sentence.
        def at(raw: Column) -> Column:
            places = F.filter(F.sequence(F.lit(0), F.size(raw) - 1), lambda i: F.rtrim(F.get(raw, i)).rlike(rf"[^{EDGES}]"))

            def site(places: Column) -> Column:
                """(verb, rest): the raw places of the verb and of what follows the relative word."""
                bare = lambda k: F.regexp_replace(F.get(raw, F.get(places, k)), r"\s+$", "")
                end = found["first"] + found["words"]
                behind = F.when(F.coalesce(bare(end).rlike(r"(?s)^\(.*\)$"), F.lit(False)), end + 1).otherwise(end)
                return F.when(F.lower(bare(behind)).isin(*RELATIVES), F.struct(F.get(places, found["at"]).alias("verb"), (F.get(places, behind) + 1).alias("rest")))

            def joined(s: Column) -> Column:
                head = F.regexp_replace(F.array_join(F.slice(raw, 1, s["verb"]), ""), r"\s+$", "")
                tail = F.regexp_replace(F.array_join(F.slice(raw, s["rest"] + 1, F.size(raw)), ""), r"^\s+", "")
                return F.when((head != "") & (tail != ""), F.concat(head, F.lit(" "), tail))

            return _let(_let(places, site), lambda s: F.when(s.isNotNull(), joined(s)))

        return _let(F.regexp_extract_all(first, F.lit(r"(\S+\s*)"), 1), at)

    def spliced(first: Column, made: Column) -> Column:
        rest = F.substring(_stripped(abstract), F.length(first) + 1, F.length(abstract))
        return F.when(made.isNotNull(), F.concat(F.regexp_extract(abstract, r"^\s*", 0), made, rest, F.regexp_extract(abstract, r"\s*$", 0))).otherwise(abstract)

    made = lambda first: _let(_opener_place(first, doc_type), lambda found: F.when(found.isNotNull(), cut(first, found)))
    return _let(first_sentence(abstract), lambda first: _let(made(first), lambda m: spliced(first, m)))


#: Identifiers, counts of a file's parts, and ranges of identifiers (fixed values).
IDENTIFIER = r"\b(?:item\d{4,12}|[A-Z]{1,10}-\d{2,12})\b"
STRUCTURE = (
    r"\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:(?:sampled|inspected)\s+)?(?:records?|rows?|columns?|fields?|departments?|sentences?)\b"
    r"|\b(?:column|field)\s*:?\s*\d+\b"
)
RANGE = r"\bitem\d{4,12}\s+(?:through|to)\s+([A-Za-z][A-Za-z0-9_-]*)\b"


def recorded_findings(candidate: Column, authored: Column) -> Column:
    """Names of the rules that a candidate breaks against what was written, in fixed order.

    ``unsupported_identifier``: it has an identifier that the authored text has not, letter for letter.
    ``bounded_structure``: it counts or numbers records, rows, columns and the like.  ``range_role``: it has a range, ``item0001 to x``,
    whose end is no identifier and which the authored text has not word for word.  Nulls are empty texts.
    """
    text, source = F.coalesce(candidate, F.lit("")), F.coalesce(authored, F.lit(""))
    all_of = lambda c, pattern, group=0: F.regexp_extract_all(c, F.lit(f"(?i){pattern}"), F.lit(group))
    foreign = F.size(F.array_except(all_of(text, IDENTIFIER), all_of(source, IDENTIFIER))) > 0
    ranges = F.zip_with(all_of(text, RANGE), all_of(text, RANGE, 1), lambda whole, end: F.struct(whole.alias("whole"), end.alias("end")))
    role = F.exists(ranges, lambda r: ~source.contains(r["whole"]) & ~r["end"].rlike(f"(?i)^(?:{IDENTIFIER})$"))
    rules = {"unsupported_identifier": foreign, "bounded_structure": text.rlike(f"(?i){STRUCTURE}"), "range_role": role}
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))


def unsupported_identifiers(text: Column, evidence: Column) -> Column:
    """Identifiers (letters, then a hyphen or underscore and digits) that a text has and its evidence has not."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b([A-Za-z]{2,}[-_]\d+)\b"), 1))
    return F.array_sort(F.array_except(found(text), found(evidence)))


def publication_findings(text: Column, evidence: Column, structure: Column) -> Column:
    """Names of the rules that a candidate breaks, in fixed order: unsupported_identifier, bounded_structure."""
    return F.array_compact(F.array(F.when(F.size(unsupported_identifiers(text, evidence)) > 0, "unsupported_identifier"), F.when(F.size(structure) > 0, "bounded_structure")))


def heading_tier(heading_path: Column, wanted: str) -> Column:
    """How well a heading fits: 0 its last part is the wanted one, 1 starts so, 2 holds it, 3 an earlier part holds it, else NULL."""
    needle = wanted.strip().lower()
    parts = F.split(F.lower(heading_path), SEPARATOR)
    leaf = F.trim(F.element_at(parts, -1))
    inside = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.contains(needle))
    return F.when(F.lit(needle == ""), None).when(leaf == needle, 0).when(leaf.startswith(needle), 1).when(leaf.contains(needle), 2).when(inside, 3)
