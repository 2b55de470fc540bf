"""Fuzzy search for short licence notices.

Every notice may differ from the text by a few edits.  A notice of ``k`` allowed
edits is split into ``k + 1`` pieces: by the pigeonhole principle one of them is
in the text unchanged.  All pieces of all notices are found in one Aho-Corasick
pass over the normalised text (words of lower-case letters and digits, one space
between); around each find the ``regex`` library's bounded-error matching
verifies the notice and gives its span and number of edits.

A find with no edits at word bounds is an exact place of the phrase.  ``base``
notices are reported by all their exact places; the other notices only add
labels and spans.  Null texts are empty; texts without words have no finds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import texts_of
from ._words import words


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    base: bool = False


#: Fixed notices: phrase, label, allowed edits; the first three are the base ones.
NOTICES = (
    Notice("cc by", "cc-by", 0, True),
    Notice("general public license", "gpl", 2, True),
    Notice("all rights reserved", "reserved", 2, True),
    Notice("licensed under the apache license version 2 0", "apache-2.0", 4),
    Notice("released under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("creative commons attribution", "cc", 2),
    Notice("licensed under cc by", "cc-by", 1),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("boost software license", "bsl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("sil open font license", "ofl", 2),
    Notice("creative commons zero", "cc0", 2),
    Notice("free and unencumbered software released into the public domain", "unlicense", 5),
)


def notices_from(table: DataFrame, most: int = 10_000) -> tuple[Notice, ...]:
    """Notices of a table (phrase, label, edits, base), at most ``most``: they go to every task with the automaton.

    Phrases are brought to lower-case words with a space between; those without words are left out.
    """
    rows = table.select("phrase", "label", "edits", "base").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} notices")
    plain = [(b" ".join(words((r["phrase"] or "").encode())).decode(), r) for r in rows]
    return tuple(sorted((Notice(p, r["label"], r["edits"] or 0, bool(r["base"])) for p, r in plain if p), key=lambda n: (n.phrase, n.label)))


def seeds(notice: Notice) -> list[tuple[str, int]]:
    """(piece, its place in the phrase): one piece more than the edits allowed."""
    text, parts = notice.phrase, notice.edits + 1
    bounds = [round(k * len(text) / parts) for k in range(parts + 1)]
    return [(text[a:b], a) for a, b in zip(bounds, bounds[1:])]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for piece, at in seeds(n):
                places.setdefault(piece, []).append((k, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?e)(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}") for n in notices]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, begin, end, edits) of every verified place in normalised text; the best of those that overlap."""
        near: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            begin = last + 1 - size
            for k, at in where:
                near.setdefault(k, []).append((begin - at, begin))
        out = []
        for k, places in near.items():
            notice = self.notices[k]
            size, slack = len(notice.phrase), notice.edits
            # Windows that hold any match around a piece; those that touch are searched as one.
            windows: list[list[int]] = []
            for start, _ in sorted(set(places)):
                a, b = max(0, start - slack), min(len(text), start + size + slack)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            for a, b in windows:
                part, at = text[a:b], 0
                while at < len(part):
                    exact = part.find(notice.phrase, at)
                    if exact < 0 and not slack:
                        break
                    m = self.patterns[k].search(part, at) if slack else None
                    if exact >= 0 and (m is None or exact <= m.end()):
                        begin, end, edits = exact, exact + size, 0
                    elif m is None or m.end() == m.start():
                        break
                    else:
                        begin, end, edits = m.start(), m.end(), sum(m.fuzzy_counts)
                    out.append((k, a + begin, a + end, edits))
                    at = end
        return out


@lru_cache
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def scan_text(text: bytes, notices: tuple[Notice, ...] = NOTICES):
    """(words, exact base places as (word, label), finds as (label, first word, words, edits, base?)) of one text."""
    ws = words(text)
    plain = b" ".join(ws).decode("utf-8", "replace")
    finds, base = [], []
    found = scanner(notices).find(plain)
    if found:
        starts = np.cumsum([0] + [len(w.decode("utf-8", "replace")) + 1 for w in ws])
        for k, begin, end, edits in sorted(found, key=lambda f: (f[1], f[0])):
            n = notices[k]
            at_words = (begin == 0 or plain[begin - 1] == " ") and (end == len(plain) or plain[end] == " ")
            if not edits and not at_words and not n.edits:
                continue
            first = int(np.searchsorted(starts, begin, "right")) - 1
            last = int(np.searchsorted(starts, max(begin, end - 1), "right")) - 1
            if n.base and not edits and at_words:
                base.append((first, n.label))
            finds.append((n.label, first, last - first + 1, edits, not edits and at_words, len(n.phrase)))
    return len(ws), base, finds


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("finds", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())]))),
])
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "finds array<struct<label string, first_word long, n_words long, edits long>>"
)


def _scan(notices: tuple[Notice, ...]):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                n, base, finds = scan_text(text, notices)
                at = [w for w, _ in base]
                # 1 for an exact find, less by the share of the phrase that was edited.
                score = max((1.0 if exact else max(0.0, 1.0 - (edits + 1) / size) for _, _, _, edits, exact, size in finds), default=0.0)
                rows.append((
                    doc_id, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in base})),
                    ",".join(sorted({f[0] for f in finds} | {b for _, b in base})), score, [dict(zip(("label", "first_word", "n_words", "edits"), f)) for f in finds],
                ))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    return run


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Per document: words, exact base places, labels, the best score and all finds with word spans and edits."""
    return docs.select("doc_id", "text").mapInArrow(_scan(notices), RESULT)
