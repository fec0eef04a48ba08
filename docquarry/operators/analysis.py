"""Pluggable analyzers: words as they stand, or pieces of words by the best path through a dictionary's lattice.

An analyzer has a version, which changes with anything that changes its terms, and gives postings. Postings are kept by version beside the
digest of the texts they come from, so each analyzer's are built once and a changed text or dictionary is never served from old ones.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import CODE, raw_words, stripped, tokens
from docquarry.operators.governance import table_digest
from docquarry.operators.matching import term_lists, words_by_text
from docquarry.operators.retrieval import text_postings
from docquarry.sources.intermediate import written
from docquarry.sources.sinks import verified_version, write_version

#: Cost of a piece that the dictionary doesn't have, and of each of its characters; those of entries are thousandths of ln(total / count).
UNKNOWN, UNKNOWN_CHARACTER = 9_000, 3_000
#: Words whose pieces a Python worker keeps.
CUT = 200_000
RUNS = re.compile(r"[^\W\d_]+|\d+")


class Analyzer(Protocol):
    @property
    def version(self) -> str: ...

    def postings(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        """(doc, term, tf); a text without a term has one placeholder."""

    def lists(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        """(doc, size, terms, tfs, sides): the same postings, a row for each doc, made without a shuffle of words."""


@dataclass(frozen=True)
class WholeWords:
    """Lower-cased words without punctuation at their ends."""

    version: str = "words-1"

    def postings(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        return text_postings(docs, doc, text)

    def lists(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        return term_lists(words_by_text(docs, doc, tokens(F.col(text))), doc)


@dataclass(frozen=True)
class Entry:
    term: str
    tag: str
    cost: int


@dataclass(frozen=True)
class Lattice:
    """Best paths through the pieces of a run of letters: the least sum of costs; of equal ones the path with fewer pieces, then the one whose pieces
    are longer from the end backwards."""

    entries: tuple[Entry, ...]

    @cached_property
    def trie(self) -> dict:
        root: dict = {}
        for e in sorted(self.entries, key=lambda e: (e.cost, e.tag), reverse=True):  # of entries of one term the cheapest is the last
            at = root
            for c in e.term:
                at = at.setdefault(c, {})
            at[""] = e
        return root

    def path(self, run: str) -> list[tuple[str, str]]:
        """(piece, tag) of a run; what no entry covers is a piece with the tag unknown."""
        n = len(run)
        best: list[tuple[int, int, int, str]] = [(0, 0, 0, "")] + [(1 << 60, 0, 0, "")] * n  # cost, pieces, start and tag of the last piece
        for a in range(n):
            cost, pieces = best[a][0], best[a][1] + 1
            at = self.trie
            for b in range(a + 1, n + 1):
                options = [(cost + UNKNOWN + UNKNOWN_CHARACTER * (b - a), pieces, a, "unknown")] if a == 0 or best[a][3] != "unknown" else []
                at = at.get(run[b - 1]) if at else None
                if at and "" in at:
                    options.append((cost + at[""].cost, pieces, a, at[""].tag))
                for option in options:
                    best[b] = min(best[b], option)
        out, b = [], n
        while b:
            _, _, a, tag = best[b]
            out.append((run[a:b], tag))
            b = a
        return out[::-1]


@dataclass(frozen=True)
class Pieces:
    """Requirement codes as written, then the pieces of words by a lattice whose tag is kept, or that negate; digits are pieces of their own."""

    entries: tuple[Entry, ...]
    kept: tuple[str, ...] = ("content", "unknown", "number")
    negations: tuple[str, ...] = ("no", "not", "non", "ne", "kein", "nicht")
    lattice: Lattice = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "lattice", Lattice(self.entries))

    @property
    def version(self) -> str:
        said = [UNKNOWN, UNKNOWN_CHARACTER, sorted((e.term, e.tag, e.cost) for e in self.entries), self.kept, self.negations, CODE]
        return f"pieces-1-{hashlib.sha256(json.dumps(said, ensure_ascii=False).encode()).hexdigest()[:16]}"

    def terms(self, word: str) -> list[str]:
        found: list[tuple[str, str]] = []
        for run in RUNS.findall(word):
            found += [(run, "number")] if run[0].isdecimal() else self.lattice.path(run)
        return [piece for piece, tag in found if tag in self.kept or piece in self.negations]

    def postings(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        """Each distinct word is cut once, whatever the number of texts that hold it."""
        words = docs.select(doc, F.explode(raw_words(F.col(text))).alias("word")).select(doc, stripped("word").alias("word")).where("word <> ''")
        counts = words.groupBy(doc, "word").agg(F.count("*").alias("times"))
        sent = docs.sparkSession.sparkContext.broadcast(self)  # of the dictionary's size, a parameter

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [sent.value.terms(w) for w in batch.column(0).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(own, pa.list_(pa.string()))], ["word", "terms"])

        cut = words.select("word").distinct().mapInArrow(run, "word string, terms array<string>")
        pieces = counts.join(cut, "word").select(doc, F.explode("terms").alias("term"), "times")
        written = docs.select(doc, F.explode(F.regexp_extract_all(text, F.lit(CODE), F.lit(1))).alias("term"))
        coded = written.select(doc, F.concat(F.lit("code:"), "term").alias("term"), F.lit(1).cast("long").alias("times"))
        known = pieces.unionByName(coded).groupBy(doc, "term").agg(F.sum("times").alias("tf"))
        none = docs.select(doc).distinct().join(known.select(doc), doc, "left_anti")
        return known.unionByName(none.select(doc, F.lit("∅").alias("term"), F.lit(1).cast("long").alias("tf")))

    def lists(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        """A Python worker cuts a word once, as long as it keeps no more than CUT words. Codes go among the words behind a mark that no word has."""
        sent = docs.sparkSession.sparkContext.broadcast(self)  # of the dictionary's size, a parameter
        coded = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CODE), F.lit(1)), lambda c: F.concat(F.lit(" code:"), c))

        def terms_of() -> Callable[[list[str]], list[list[str]]]:
            own = sent.value
            known: dict[str, list[str]] = vars(own.lattice).setdefault("cut", {})

            def cut(words: list[str]) -> list[list[str]]:
                out = []
                for w in words:
                    found = known.get(w)
                    if found is None:
                        found = [w[1:]] if w.startswith(" ") else own.terms(w)
                        if len(known) < CUT:
                            known[w] = found
                    out.append(found)
                return out

            return cut

        found = term_lists(words_by_text(docs, doc, F.concat(tokens(F.col(text)), coded)), doc, terms_of)
        none = F.col("size") == 0
        return found.select(
            doc,
            F.when(none, 1).otherwise(F.col("size")).alias("size"),
            F.when(none, F.array(F.lit("∅"))).otherwise(F.col("terms")).alias("terms"),
            F.when(none, F.array(F.lit(1))).otherwise(F.col("tfs")).alias("tfs"),
            "sides",
        )


def entries_of(rows: Iterable[Sequence]) -> tuple[Entry, ...]:
    return tuple(sorted((Entry(r[0], r[1], int(r[2])) for r in rows), key=lambda e: (e.term, e.tag, e.cost)))


def dictionary(docs: DataFrame, text: str, size: int = 20_000, shortest: int = 2, longest: int = 6, least: int = 3, function_words: int = 40) -> DataFrame:
    """(term, tag, cost) of the `size` most frequent short words of all texts: cost is ln(total / count) in thousandths; the
    `function_words` most frequent ones have the tag function, others content."""
    words = docs.select(F.explode(raw_words(F.col(text))).alias("word")).select(stripped("word").alias("term"))
    short = words.where(F.length("term").between(shortest, longest) & F.col("term").rlike(r"^\p{L}+$"))
    counts = written(short.groupBy("term").agg(F.count("*").alias("n")))
    total = F.lit(counts.agg(F.sum("n")).first()[0])
    first = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(size)
    names = first.orderBy(F.desc("n"), "term").limit(function_words).select("term", F.lit("function").alias("tag"))
    return first.join(names, "term", "left").select("term", F.coalesce("tag", F.lit("content")).alias("tag"), F.round(1000 * F.ln(total / F.col("n"))).cast("int").alias("cost"))


def kept_postings(docs: DataFrame, doc: str, text: str, analyzer: Analyzer, root: str) -> tuple[DataFrame, bool]:
    """(postings, whether they were there): a verified version below root, named by the analyzer and the texts, written if it isn't there."""
    return kept(docs.select(F.col(doc), F.col(text)), f"{analyzer.version}|{doc}|{text}", lambda own: analyzer.postings(own, doc, text), root)


def kept_lists(docs: DataFrame, doc: str, text: str, analyzer: Analyzer, root: str) -> tuple[DataFrame, bool]:
    """kept_postings as lists, a row for each doc."""
    return kept(docs.select(F.col(doc), F.col(text)), f"{analyzer.version}|lists|{doc}|{text}", lambda own: analyzer.lists(own, doc, text), root)


def kept(own: DataFrame, name: str, make: Callable[[DataFrame], DataFrame], root: str) -> tuple[DataFrame, bool]:
    said = table_digest(own).first()
    version = hashlib.sha256(f"{name}|{said['n_rows']}|{said['digest']}".encode()).hexdigest()[:24]
    spark = own.sparkSession
    try:
        return verified_version(spark, root, version), True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    write_version(make(own), root, version)
    return verified_version(spark, root, version), False
