"""Keyword mode: lexeme match and rank over passages and document surfaces.

A query is words, ``"phrases"``, ``OR`` between branches and ``-word`` or ``-"phrase"``
for what must be absent.  Words become lexemes as texts do, so matching is between
equal strings, and everything past the short query text is column expressions:
a row is judged where it lies, and documents are aggregated once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem_array, stem_column, stem_word
from ..functions.text import fold_for_query

#: Words without meaning of their own in a query (fixed values).
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: Weights of a hit in a passage and in a document's surface, and the sum of 1/j^2 (fixed values).
PASSAGE, SURFACE, BASEL = 0.1, 1.0, 1.64493406685


def plain(text: Column) -> Column:
    """A text's words in order, with a space between: lower-case runs of letters and digits."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """Array of a text's words in order."""
    return F.filter(F.split(plain(text), " "), lambda w: w != "")


def lexemes(text: Column) -> Column:
    """Array of the stems of a text's words, worked out word by word; an index stems its vocabulary once instead."""
    return F.transform(words(text), stem_column)


class Stems:
    """Stems of arrays of words, of which each is worked out once as long as ``KEPT`` words are not passed."""

    KEPT = 300_000

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def __call__(self, vocabulary: pa.Array) -> pa.Array:
        said = vocabulary.to_pylist()
        if len(self.known) + len(said) > self.KEPT:
            self.known = {}
        new = [w for w in said if w not in self.known]
        self.known.update(zip(new, stem_array(pa.array(new, pa.string())).to_pylist()))
        return pa.array([self.known[w] for w in said], pa.string())


def lexemes_of(text: Column) -> Column:
    """What ``lexemes`` gives, batch by batch: each word of a task is stemmed once."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stems = Stems()
        for texts in batches:
            said = pc.split_pattern(texts, " ")
            coded = said.flatten().dictionary_encode()
            yield pa.ListArray.from_arrays(said.offsets, stems(coded.dictionary).take(coded.indices))

    # A text without words is one empty one.
    return F.filter(run(plain(text)), lambda w: w != "")


@dataclass
class KeywordQuery:
    """Branches of operands, each one lexeme or the lexemes of a phrase, and what must be absent."""

    branches: list[list[tuple[str, ...]]] = field(default_factory=list)
    excluded: list[tuple[str, ...]] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    @property
    def required(self) -> list[str]:
        return sorted({w for b in self.branches for o in b for w in o})


def _words(text: str) -> list[str]:
    return [stem_word(w) for w in re.findall("[a-z0-9]+", text.lower())]


def parse(text: str) -> KeywordQuery:
    """The query's operands; a stop word alone is dropped, inside a phrase it stays."""
    out, branch = KeywordQuery(), []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word == "OR" and not minus:
            if branch:
                out.branches.append(branch)
            branch = []
            continue
        found = tuple(_words(quoted or word))
        if word and (not found or len(found) == 1 and word.lower().strip("-") in STOP_WORDS):
            out.dropped.append(word)
        elif found and minus:
            out.excluded.append(found)
        elif found:
            branch.append(found)
    if branch:
        out.branches.append(branch)
    return out


def forms(query: str) -> tuple[str, str | None]:
    """The query, and its folded form (hyphens and underscores to spaces, compounds apart) where that differs and has lexemes."""
    parts = [re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", w) if re.fullmatch("[A-Za-z]+", w) else w for w in re.sub(r"(?<=\w)[-_](?=\w)", " ", query).split(" ")]
    folded = " ".join(parts)
    return query, folded if folded != query and parse(folded).branches else None


def query_terms(text: Column) -> tuple[Column, Column]:
    """The sorted lexemes of many plain queries, and those of their folded forms without stop words; NULL where folding changes nothing."""
    folded = fold_for_query(text)
    sorted_ = lambda lex: F.array_join(F.array_sort(F.array_distinct(lex)), " ")
    kept = F.filter(lexemes(folded), lambda w: ~w.isin(*sorted(STOP_WORDS)))
    return sorted_(lexemes(text)), F.when((folded != text) & (F.size(kept) > 0), sorted_(kept))


def held(padded: Column, operand: tuple[str, ...]) -> Column:
    """Does a text, as its lexemes with a space around each, hold a lexeme or the lexemes of a phrase next to each other."""
    return padded.contains(" " + " ".join(operand) + " ")


def padded(lexemes_: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(lexemes_, " "), F.lit(" "))


def satisfied(padded_: Column, query: KeywordQuery) -> Column:
    """Does one unit satisfy the whole query: a branch in full (if there is one) and nothing that is excluded."""
    branches = [reduce(lambda a, b: a & b, [held(padded_, o) for o in branch]) for branch in query.branches]
    found = reduce(lambda a, b: a | b, branches) if branches else F.lit(True)
    return reduce(lambda a, o: a & ~held(padded_, o), query.excluded, found)


def rank(lexemes_: Column, terms: Sequence[str], weight: float) -> Column:
    """Rank of a text by any of the terms: each adds its weight times the sum of 1/j^2 over its hits, over their number."""
    if not terms:
        return F.lit(0.0)
    hits = lambda t: F.size(F.filter(lexemes_, lambda w: w == t))
    one = lambda t: F.when(hits(t) > 0, F.aggregate(F.sequence(F.lit(1), hits(t)), F.lit(0.0), lambda s, j: s + weight / (j * j).cast("double"))).otherwise(0.0)
    return reduce(lambda a, b: a + b, [one(t) for t in terms]) / BASEL / len(terms)


def surfaces(docs: DataFrame) -> DataFrame:
    """(document_id, matchable, orienting): what of a document itself may satisfy a match, and what only ranks.

    Matchable are the title, the tags and the file's name, which people wrote; the
    abstract is derived text and orients only.
    """
    stem_ = F.regexp_extract("source_path", r"([^/]*?)(\.[^./]*)?$", 1)
    return docs.select(F.col("id").alias("document_id"), F.concat_ws(" ", "title", F.array_join("tags", " "), stem_).alias("matchable"), F.col("semantic_abstract").alias("orienting"))


def keyword_search(passages: DataFrame, surfaces_: DataFrame, text: str, visible: DataFrame | None = None) -> DataFrame:
    """Documents that match, with their scores: document_id, score, chunk_index of the best passage, matched_passages.

    Without exclusions a document matches if for every operand of a branch some
    passage or its surface holds it; with them (or without any operand) one
    passage or the surface must satisfy the whole query.  The folded form may match on
    the surface alone.  The score is the greatest of the best passage's rank, the surface's
    and the folded surface's; derived text ranks but never matches.
    ``visible`` (document_id) limits the documents.
    """
    query, folded = (None if q is None else parse(q) for q in forms(text))
    if not query.branches and not query.excluded:
        return passages.sparkSession.createDataFrame([], "document_id string, score double, chunk_index int, matched_passages long")
    if visible is not None:
        passages, surfaces_ = (t.join(visible.select("document_id"), "document_id", "left_semi") for t in (passages, surfaces_))
    operands = sorted({o for b in query.branches for o in b})
    single = bool(query.excluded) or not operands
    row = passages.where("chunk_index >= 0").select("document_id", "chunk_index", lexemes_of(F.col("content")).alias("lex"))
    both = lexemes_of(F.concat_ws(" ", "matchable", "orienting"))
    top = surfaces_.select("document_id", F.lit(None).cast("int").alias("chunk_index"), lexemes_of(F.col("matchable")).alias("lex"), both.alias("wide"))
    score = lambda lex, q, weight: rank(lex, q.required, weight)
    units = row.select("*", score(F.col("lex"), query, PASSAGE).alias("score"), F.lit(False).alias("folded"))
    other = score(F.col("wide"), folded, SURFACE) if folded else F.lit(0.0)
    arm = satisfied(padded(F.col("lex")), folded) if folded else F.lit(False)
    units = units.unionByName(top.select("document_id", "chunk_index", "lex", F.greatest(score(F.col("wide"), query, SURFACE), F.when(arm, other).otherwise(0.0)).alias("score"), arm.alias("folded")))
    judged = units.withColumn("pad", padded(F.col("lex"))).select(
        "document_id", "chunk_index", "score", "folded", satisfied(F.col("pad"), query).alias("whole"), *[held(F.col("pad"), o).alias(f"o{k}") for k, o in enumerate(operands)]
    )
    any_held = reduce(lambda a, b: a | b, [F.col(f"o{k}") for k in range(len(operands))], F.lit(False))
    hit = F.col("whole") if single else any_held
    passage = F.col("chunk_index").isNotNull()
    found = judged.groupBy("document_id").agg(
        F.max(F.when(hit | ~passage, F.col("score"))).alias("score"), F.min(F.when(passage & hit, F.struct((-F.col("score")).alias("s"), "chunk_index"))).alias("best"),
        F.count_if(passage & hit).alias("matched_passages"), F.max("folded").alias("folded"), F.max("whole").alias("whole"), *[F.max(f"o{k}").alias(f"o{k}") for k in range(len(operands))],
    )
    named = {o: F.col(f"o{k}") for k, o in enumerate(operands)}
    across = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [named[o] for o in branch]) for branch in query.branches]) if query.branches else F.lit(False)
    return found.where((F.col("whole") if single else across) | F.col("folded")).select("document_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("best.chunk_index").alias("chunk_index"), "matched_passages")


def advice(text: str, found: int) -> list[str]:
    """Why an empty result may be empty, by the shape of the query; nothing for results that are not."""
    if found:
        return []
    query = parse(text)
    out = []
    if query.dropped and not query.branches:
        out.append("only common words: " + " ".join(query.dropped))
    if not query.branches and query.excluded:
        out.append("only exclusions")
    if any(len(o) > 1 for b in query.branches for o in b):
        out.append("a phrase must stand in one passage")
    if query.branches and query.excluded:
        out.append("exclusions hold the whole query to one passage")
    if max((len(b) for b in query.branches), default=0) > 1 and not out:
        out.append("every word must occur; OR allows any")
    return out
