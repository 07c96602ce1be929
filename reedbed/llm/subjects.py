"""Subject areas of documents: weighted terms found by one automaton, term rarity, calibrated thresholds, shares of sentences.

Method: terms of all languages, each with a curated weight, are matched at once by a multi-pattern automaton over a cleaned
text. A term that only follows a preposition of means is named in passing; the others act or are acted on. A sentence's score
for a subject is the sum of its terms' weights times their rarity, which follows from the number of documents that have the
term. Of a term of several subjects one is meant, which the sentence or else the document tells. A sentence is about a subject
if its score reaches the subject's threshold, calibrated on labelled documents; the number of sentences normalises for length,
and a document has every subject that a share of SHARE of its sentences is about.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reedbed.plans.runtime import materialise, table

#: Curated terms: subject (- for none), weight, and the term in English, German, French, Spanish, Russian and Japanese.
TERMS = str(Path(__file__).with_name("subject_terms.tsv"))
#: Share of a document's sentences from which a subject is its subject.
SHARE = Fraction(3, 10)
#: Prepositions of means; what follows them (in Japanese: comes before) is named in passing.
PASSING = (
    "through", "via", "by means of", "by way of", "durch", "mittels", "mithilfe", "anhand", "à travers", "au moyen de", "par le biais de",
    "a través", "mediante", "por medio de", "через", "посредством", "с помощью", "при помощи",
)
PASSING_AFTER = ("を通じて", "を通して", "を介して", "によって")
#: Words of the sentences around the terms, so that they aren't taken for misspelt terms.
COMMON = tuple(
    "improve influence limit test protect support show replace change connect describe use many people ask why since page "
    "verbessern beeinflussen begrenzen prüfen schützen unterstützen zeigen ersetzen verändern verbinden beschreiben nutzen viele warum seit seite die und "
    "améliorent influencent limitent testent protègent soutiennent montrent remplacent changent relient décrivent utilisent beaucoup demandent pourquoi depuis les "
    "mejoran afectan limitan prueban protegen apoyan muestran reemplazan cambian conectan describen usan muchos preguntan desde página los las "
    "улучшают затрагивают ограничивают проверяют защищают поддерживают показывают заменяют меняют соединяют описывают используют многие спрашивают почему года городе странице".split()
)

_MARKS = re.compile("[̀-ͯ]")
_HIDDEN = re.compile("[­​-‏⁠﻿︎️]")
_SPECIAL = re.compile(r"<\|[^|<>]*\|>|</?(?:s|b|i|u|em|strong|span|a|unk|pad|bos|eos|sup|sub)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_END = re.compile(r"[.。!?！？…]+")
_WORD = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"[^\W_]+|[,、，;:：]")
_MOJIBAKE = re.compile("[\u0080-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{2,}")
_JAPANESE = re.compile("[぀-ヿ㐀-鿿]")


def folded(text: str) -> str:
    """Case, accents, hidden characters and compatibility forms removed."""
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).casefold()
    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", text)))


def _reread(run: re.Match) -> str:
    raw = b"".join(c.encode("cp1252") if ord(c) > 255 else bytes((ord(c),)) for c in run[0])
    text = raw.decode("utf-8", "replace")
    return text if text.count("�") * 4 <= len(text) else run[0]


def repaired(text: str) -> str:
    """Runs of characters that are UTF-8 read as an eight-bit code, put right; markup and entities resolved."""
    return _TAG.sub(" ", _SPECIAL.sub("", html.unescape(_MOJIBAKE.sub(_reread, text))))


def _near(word: str) -> set[str]:
    """The word and what is left of it without one letter."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


class Matcher:
    """The automaton over all terms, and the correction of words one edit away from a word of theirs."""

    def __init__(self, path: str):
        import ahocorasick

        subjects: dict[str, set[str]] = defaultdict(set)
        self.weights: dict[tuple[str, str], float] = {}
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                subject, weight, *terms = line.rstrip("\n").split("\t")
                for term in terms:
                    for form in {term, *_singular(term)} - {""}:
                        subjects[self._pattern(form)] |= {subject} - {"-"}
                        self.weights[self._pattern(form), subject] = float(weight)
        self.subjects = dict(subjects)
        self.names = sorted(self.subjects)
        self.numbers = {x: k for k, x in enumerate(self.names)}
        self.automaton = ahocorasick.Automaton()
        for pattern in subjects:
            self.automaton.add_word(pattern, (len(pattern), "term", pattern))
        for words, kind in ((PASSING, "before"), (PASSING_AFTER, "after")):
            for word in words:
                self.automaton.add_word(self._pattern(word), (len(self._pattern(word)), kind, word))
        self.automaton.make_automaton()
        self.words = {w for p in subjects for w in p.split() if not _JAPANESE.search(w)} | {w for p in PASSING for w in folded(p).split()}
        self.words |= {folded(w) for w in COMMON}
        self.near: dict[str, set[str]] = defaultdict(set)
        for word in self.words:
            if len(word) > 4:
                for x in _near(word):
                    self.near[x].add(word)
        self.corrected: dict[str, str] = {}

    @staticmethod
    def _pattern(term: str) -> str:
        term = folded(term)
        return term if _JAPANESE.search(term) else "".join(f" {x} " for x in _WORD.findall(term))

    def _word(self, word: str) -> str:
        """The word of the terms that is one edit away, if there is just one or all mean the same."""
        if word in self.words or len(word) < 5:
            return word
        found = self.corrected.get(word)
        if found is None:
            near = {y for x in _near(word) for y in self.near.get(x, ())}
            near = {y for y in near if _one_edit(word, y)}
            alike = len({frozenset(self.subjects.get(f" {y} ", {y})) for y in near}) == 1
            found = min(near) if alike else word
            if len(self.corrected) > 1_000_000:
                self.corrected.clear()
            self.corrected[word] = found
        return found

    def sentence(self, text: str) -> tuple[list[str], bool]:
        """Patterns of the terms that act or are acted on, and whether there is anything at all in the sentence."""
        words = _PARTS.findall(text)
        if not any(_WORD.match(x) for x in words):
            return [], False
        line = "".join(x if _JAPANESE.search(x) else f" {self._word(x)} " for x in words)
        best: list[tuple[int, int, str, str]] = []
        for end, (length, kind, what) in self.automaton.iter(line):
            start = end - length + 1
            while best and start <= best[-1][0] and length > best[-1][1] - best[-1][0]:
                best.pop()
            if not best or start >= best[-1][1]:
                best.append((start, end + 1, kind, what))
        terms = []
        for k, (start, end, kind, what) in enumerate(best):
            if kind != "term":
                continue
            if k and best[k - 1][2] == "before" and self._close(line[best[k - 1][1] : start]):
                continue
            if k + 1 < len(best) and best[k + 1][2] == "after" and best[k + 1][0] == end:
                continue
            terms.append(what)
        return terms, True

    @staticmethod
    def _close(between: str) -> bool:
        return len(between.split()) <= 2 and not re.search("[,、，;:：]", between)

    def evidence(self, text: str | None) -> tuple[int, list[list[int]]]:
        """The number of sentences with anything in them, and the numbers of the terms of those that have some."""
        sentences = [terms for part in _END.split(folded(repaired(text or "").replace("…", "."))) for terms, there in [self.sentence(part)] if there]
        return len(sentences), [[self.numbers[t] for t in terms] for terms in sentences if terms]

    def scores(self, sentences: list[list[int]], rarity: list[float] | None = None) -> list[dict[str, float]]:
        """Each sentence's score for its subjects, from the numbers of its terms and the terms' rarity."""
        worth = lambda n, subject: self.weights[self.names[n], subject] * (rarity[n] if rarity else 1)
        total: dict[str, float] = defaultdict(float)
        for terms in sentences:
            for n in terms:
                meant = self.subjects[self.names[n]]
                for subject in meant:
                    total[subject] += worth(n, subject) / len(meant)
        out = []
        for terms in sentences:
            found: dict[str, float] = defaultdict(float)
            for n in terms:
                if len(meant := self.subjects[self.names[n]]) == 1:
                    (subject,) = meant
                    found[subject] += worth(n, subject)
            sure = set(found)
            for n in terms:
                meant = self.subjects[self.names[n]]
                if len(meant) > 1:
                    subject = max(sorted(meant & sure or meant), key=lambda x: total[x])
                    found[subject] += worth(n, subject)
            out.append(found)
        return out

    def found(self, sentences: int, scores: list[dict[str, float]], thresholds: dict[str, float], share: Fraction = SHARE) -> list[str]:
        """The subjects that a share of the sentences is about."""
        about: dict[str, int] = defaultdict(int)
        for one in scores:
            for subject, score in one.items():
                if score >= thresholds.get(subject, 0.0):
                    about[subject] += 1
        return sorted(x for x, n in about.items() if n >= share * sentences)


def _singular(term: str) -> set[str]:
    """The other number of a single plural word in s, as English, French and Spanish form it, where the correction of one
    edit doesn't find it: words of four letters, and those in ies."""
    word = folded(term)
    if not re.fullmatch("[a-z]{4,}s", word):
        return set()
    other = word[:-3] + "y" if word.endswith("ies") else word[:-1]
    return {other} - set(COMMON) if len(other) == 4 or other.endswith("y") else set()


def _one_edit(a: str, b: str) -> bool:
    """One letter more, less or other, or two neighbours changed."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


@lru_cache(maxsize=2)
def matcher(path: str = TERMS) -> Matcher:
    return Matcher(path)


def _rarity(df: dict[int, int], documents: int, terms: int) -> list[float]:
    """From 1 for a term that no document has down towards 0 for one that all have."""
    return [math.log1p(documents / (df.get(n, 0) + 1)) / math.log1p(documents) if documents else 1.0 for n in range(terms)]


def limits(n: int, scores: list[dict[str, float]], labels: set[str], share: Fraction = SHARE) -> Iterator[tuple[str, float, bool]]:
    """(subject, score, labelled) of a labelled document of n sentences: up to the score that its so-manieth sentence has, it
    has the subject; -1 if it never has one that it is labelled with."""
    k = max(1, math.ceil(share * n))
    for subject in sorted(labels.union(*scores)):
        own = sorted((x[subject] for x in scores if subject in x), reverse=True)
        if len(own) >= k or subject in labels:
            yield subject, own[k - 1] if len(own) >= k else -1.0, subject in labels


def calibrated(documents: list[tuple[int, list[dict[str, float]], set[str]]], share: Fraction = SHARE) -> dict[str, float]:
    """Thresholds of the sentences' scores from (sentences, scores, labels) of labelled documents: of 0 and all of each
    subject's scores the one with the best F1; of equals the smallest, so that nothing is left out without evidence."""
    by: dict[str, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    for n, scores, labels in documents:
        for subject, score, labelled in limits(n, scores, labels, share):
            by[subject][0][score] += 1
            by[subject][1][score] += labelled
    out = {}
    for subject, (rows, true) in sorted(by.items()):
        best, chosen, hits = 0.0, 0, 0
        tried = sorted((x for x in rows if x >= 0), reverse=True)
        for k, score in enumerate(tried):
            hits += true[score]
            chosen += rows[score]
            f1 = 2 * hits / (chosen + true.total())
            if f1 and f1 >= best:
                best, out[subject] = f1, score if k + 1 < len(tried) else 0.0
    return out


def _calibrated(labelled: DataFrame, path: str, rarity: list[float], share: Fraction) -> dict[str, float]:
    """The same from rows (sentences, terms, labels) of any number: scores are counted and summed up as tables, and the driver
    gets a threshold a subject."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(path)
        for batch in batches:
            found = [x for n, terms, labels in zip(*(c.to_pylist() for c in batch.columns)) for x in limits(n, own.scores(terms, rarity), set(labels), share)]
            columns = zip(*found) if found else ((), (), ())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()))], names=["subject", "score", "labelled"])

    scores = labelled.select("sentences", "terms", "labels").mapInArrow(read, "subject string, score double, labelled boolean")
    counts = scores.groupBy("subject", "score").agg(F.count("*").alias("n"), F.count_if("labelled").alias("true"))
    falling = Window.partitionBy("subject").orderBy(F.desc("score"))
    above = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f1 = 2 * F.sum("true").over(above) / (F.sum("n").over(above) + F.sum("true").over(Window.partitionBy("subject")))
    least = F.coalesce(F.lead("score").over(falling), F.lit(-1.0)) < 0
    tried = counts.select("subject", "score", f1.alias("f1"), F.when(least, 0.0).otherwise(F.col("score")).alias("threshold")).where("score >= 0 AND f1 > 0")
    best = tried.groupBy("subject").agg(F.max(F.struct("f1", (-F.col("threshold")).alias("low"))).alias("best")).collect()
    return {r.subject: -r.best.low for r in best}


def subjects(docs: DataFrame, labels: DataFrame | None = None, terms: str | None = None, share: Fraction = SHARE) -> DataFrame:
    """(doc_id, subject): each subject that at least the share of the text's sentences is about.

    A null, empty or contentless text has none. Whole texts are read once; what they have of terms is written, from which the
    terms' document frequencies over all documents, the calibration and the result follow. labels: (doc_id, subject), all
    of which count, repeated ones once; without them every sentence with a term of a subject is about it. A document's rows
    each count, an empty table gives no rows, other columns are not read. The driver gets one number a term and one a
    subject."""
    path = terms or TERMS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(path)
        for batch in batches:
            found = [own.evidence(text) for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.list_(pa.int32())))]
            yield pa.record_batch(columns, names=["doc_id", "sentences", "terms"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    evidence = materialise(texts.mapInArrow(read, "doc_id long, sentences int, terms array<array<int>>"), "evidence")
    counts = evidence.select(F.explode(F.array_distinct(F.flatten("terms"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    own = matcher(path)
    rarity = _rarity({r.term: r.n for r in counts}, evidence.count(), len(own.names))
    thresholds: dict[str, float] = {}
    if labels is not None:
        some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("subject").cast("string").alias("subject")).dropna().distinct()
        some = some.groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
        thresholds = _calibrated(evidence.join(some, "doc_id"), path, rarity, share)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(path)
        for batch in batches:
            ids, found = [], []
            for number, n, sentences in zip(*(c.to_pylist() for c in batch.columns)):
                for subject in own.found(n, own.scores(sentences, rarity), thresholds, share):
                    ids.append(number)
                    found.append(subject)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["doc_id", "subject"])

    return evidence.where(F.size("terms") > 0).mapInArrow(decide, "doc_id long, subject string")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_label"))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return p8_found(spark, sf_dir).join(docs, "doc_id").groupBy("source", "subject").agg(F.count("*").alias("docs"))


QUERIES = {"p8_found": p8_found, "p8_composition": p8_composition}
ORACLES: dict[str, str] = {}
