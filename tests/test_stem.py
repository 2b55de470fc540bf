"""Stems against a plain stemmer written apart, over all words of the documents."""

import re

import duckdb
import pytest

from conftest import DATA
from corvane.functions import stem

KNOWN = {
    "consign": "consign", "consigned": "consign", "consignment": "consign", "consistency": "consist", "consolatory": "consolatori", "knightly": "knight", "kneeling": "kneel", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi",
    "agreed": "agre", "feed": "feed", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "national": "nation", "generously": "generous", "communication": "communic", "arsenal": "arsenal", "skies": "sky", "news": "news", "inning": "inning",
    "proceeding": "proceed", "controlling": "control", "probate": "probat", "rate": "rate", "cease": "ceas", "boyish": "boyish", "flying": "fli", "yes": "yes", "say": "say", "by": "by", "cry": "cri", "analogies": "analog", "sensibility": "sensibl",
    "electricity": "electr", "adjustable": "adjust", "adoption": "adopt", "e": "e", "": "", "relational": "relat", "happily": "happili", "sky": "sky", "dying": "die", "roll": "roll", "shed": "shed", "sized": "size", "bed": "bed", "youth": "youth", "2024s": "2024s",
}


class Apart:
    """The same algorithm as a loop over states, region by region."""

    V = set("aeiouy")

    def region(self, w, start=0):
        for i in range(start + 1, len(w)):
            if w[i] not in self.V and w[i - 1] in self.V:
                return i + 1
        return len(w)

    def short(self, w):
        if len(w) == 2:
            return w[0] in self.V and w[1] not in self.V
        return len(w) > 2 and w[-1] not in self.V | set("wxY") and w[-2] in self.V and w[-3] not in self.V

    def __call__(self, word):
        if len(word) < 3 or word in stem.UNCHANGED:
            return word
        if word in stem.SPECIAL:
            return stem.SPECIAL[word]
        w = ""
        for c in word:
            w += "Y" if c == "y" and (not w or w[-1] in self.V) else c
        self.r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), self.region(w))
        self.r2 = self.region(w, self.r1)
        vowel = lambda x: any(c in self.V for c in x)
        if w.endswith("sses"):
            w = w[:-2]
        elif w.endswith(("ied", "ies")):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
            w = w[:-1]
        if w in stem.STOPPED:
            return w
        for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
            if w.endswith(end):
                if end[:3] == "eed":
                    w = w[: -len(end)] + "ee" if len(w) - len(end) >= self.r1 else w
                elif vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w[-2:] in ("at", "bl", "iz"):
                        w += "e"
                    elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                        w = w[:-1]
                    elif self.r1 >= len(w) and self.short(w):
                        w += "e"
                break
        if len(w) > 2 and w[-1] in "yY" and w[-2] not in self.V - {"Y"}:
            w = w[:-1] + "i"
        for table, region in (({**stem.STEP_2, "ogi": "og", "li": ""}, "r1"), ({**stem.STEP_3, "ative": ""}, "r1"), ({**dict.fromkeys(stem.STEP_4, ""), "ion": ""}, "r2")):
            for end in sorted(table, key=len, reverse=True):
                if w.endswith(end):
                    at = len(w) - len(end)
                    fine = at >= getattr(self, region) and (end != "ogi" or w[:at].endswith("l")) and (end != "li" or w[at - 1] in "cdeghkmnrt") and (end != "ative" or at >= self.r2) and (end != "ion" or w[at - 1 : at] in ("s", "t"))
                    w = w[:at] + table[end] if fine else w
                    break
        if w.endswith("e") and (len(w) - 1 >= self.r2 or len(w) - 1 >= self.r1 and not self.short(w[:-1])) or w.endswith("ll") and len(w) - 1 >= self.r2:
            w = w[:-1]
        return w.lower()


@pytest.fixture(scope="module")
def vocabulary():
    texts = duckdb.sql(f"SELECT text FROM '{DATA}/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    return sorted({w for (t,) in texts for w in re.findall("[a-z0-9]+", t.lower())} | set(KNOWN) | {a + b for a in ("gener", "yyy", "hop", "controll", "abil", "sayy") for b in (*stem.STEP_2, *stem.STEP_3, *stem.STEP_4, "ative", "ing", "edly", "y", "s", "ly", "e", "ll")})


def test_known_words():
    assert {w: stem.stem_word(w) for w in KNOWN} == KNOWN


def test_all_words(spark, vocabulary):
    apart = Apart()
    want = {w: apart(w) for w in vocabulary}
    assert {w: (stem.stem_word(w), v) for w, v in want.items() if stem.stem_word(w) != v} == {}
    got = {r["word"]: r["lexeme"] for r in stem.stems(spark.createDataFrame([(w,) for w in [*vocabulary, None]], "word string")).collect()}
    assert {w: (got[w], v) for w, v in want.items() if got[w] != v} == {}
