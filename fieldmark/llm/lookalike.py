"""Visually identical text: one consistent form for widths, accents, spaces and look-alike letters.

Method: a longest-match transducer, compiled once a worker to a trie, reads a text's grapheme clusters
in one pass. Its mapping is computed from the Unicode character database by rule, with the look-alike
letters as fixed values, and checked for conflicts: no key maps twice, no output is changed again,
and no letter loses a visible accent.

What is brought together: full and half width forms, ligatures, letters of other alphabets that look
like Latin ones, characters in composed and decomposed form, blanks of any width, hyphens that look
alike; invisible characters are dropped. What stays different: line breaks, letter case, visible
accents, punctuation that looks different, the number of blanks.

Defined results: null stays null; an empty text stays empty; the form of a form is itself; a text of
any length is read whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.plans.lineage import cut

# Letters that look like a Latin letter, digit or other letter in usual fonts.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Һ": "h", "Ӏ": "I", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ү": "y", "ӏ": "l", "ѵ": "v", "ԍ": "G",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J", "Ϲ": "C",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    # Armenian, Cherokee, Latin letters of other use
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Օ": "O", "Ս": "U", "Ꭺ": "A", "Ꭼ": "E", "Ꮃ": "W", "Ꮪ": "S", "Ꮯ": "C", "Ꮲ": "P", "Ꮋ": "H", "Ꭲ": "T", "ɡ": "g", "ɑ": "a", "ʋ": "v",
    # letter signs of other blocks
    "ℓ": "l", "ℯ": "e", "ℴ": "o",
    # hyphens, dots, apostrophes and bars that are drawn alike
    "…": "...",
    # several characters that are drawn like one: a letter with its dot, and a dotless one with a dot
    "ı\u0307": "i", "i\u0307": "i", "ȷ\u0307": "j", "j\u0307": "j",
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "ʼ": "’", "․": ".", "ǀ": "|", "∣": "|",
}

_BLANKS = {c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs"}


def _invisible(c: str) -> bool:
    n = ord(c)
    return unicodedata.category(c) == "Cf" and n not in (0x600, 0x601, 0x602, 0x603, 0x6DD, 0x70F) or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or n in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


def build_mapping() -> dict[str, str]:
    """Every mapped character or cluster with its form; raises on a conflict."""
    table: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if key != value and table.setdefault(key, value) != value:
            raise ValueError(f"{key!r} maps to {table[key]!r} and {value!r}")

    for n in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= n <= 0xDFFF:
            continue
        c = chr(n)
        if c in LOOKALIKES:
            continue
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if _invisible(c):
            put(c, "")
        elif c in _BLANKS:
            put(c, " ")
        elif kind in ("<wide>", "<narrow>", "<font>") or (kind == "<compat>" and 0xFB00 <= n <= 0xFB06):
            put(c, unicodedata.normalize("NFC", "".join(chr(int(x, 16)) for x in rest.split()) if kind != "<font>" else unicodedata.normalize("NFKC", c)))
    for c, form in LOOKALIKES.items():
        put(c, form)
    # a look-alike and the marks that follow it, where the composed letter exists: one key, so that the
    # letter is found whole
    bases: dict[str, list[str]] = {}
    for c, form in LOOKALIKES.items():
        if len(c) == 1 and len(form) == 1:
            bases.setdefault(form, []).append(c)
    for n in range(0x80, 0x2000):
        whole = chr(n)
        parts = unicodedata.normalize("NFD", whole)
        if len(parts) > 1 and unicodedata.normalize("NFC", whole) == whole and whole not in table:
            base = LOOKALIKES.get(parts[0], parts[0])
            for c in (parts[0], base, *bases.get(base, ())):
                put(c + parts[1:], unicodedata.normalize("NFC", base + parts[1:]))
    # outputs are brought to their own form, so that one pass suffices
    for key in list(table):
        value = table[key] if len(key) > 1 else "".join(table.get(x, x) for x in table[key])
        if any(x in table for x in value):
            raise ValueError(f"{key!r} needs more than two steps")
        table[key] = value
    for key, value in table.items():
        marks = [sum(unicodedata.combining(x) > 0 for x in unicodedata.normalize("NFD", t)) for t in (key, value)]
        if value and marks[0] > marks[1] and key[0] not in "ıȷij":  # their dot is no accent
            raise ValueError(f"{key!r} loses a visible accent")
    return table


class Transducer:
    """Longest-match rewriting over grapheme clusters, compiled once to a trie of the mapping's keys.

    A text is read from left to right; runs of ASCII are passed on as they are. Each cluster, in
    canonical order of its marks and without invisible characters, is walked through the trie, which
    takes the longest key at each place. Clusters recur, so their forms are kept."""

    def __init__(self, mapping: dict[str, str], kept: int = 1 << 16):
        self.trie: dict = {}
        for key, value in mapping.items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = value
        self.dropped = {ord(k): None for k, v in mapping.items() if len(k) == 1 and not v}
        # an ASCII character begins a cluster of its own where a mark or joiner follows it
        self.run = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
        self.clusters = regex.compile(r"\X")
        self.known: dict[str, str] = {}
        self.kept = kept

    def _match(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            node, end, value, k = self.trie, at + 1, text[at], at
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    end, value = k, node[""]
            out.append(value)
            at = end
        return "".join(out)

    def cluster(self, text: str) -> str:
        form = self.known.get(text)
        if form is None:
            # canonical order once more behind a width form or ligature, whose letters may take marks
            first = self._match(unicodedata.normalize("NFD", text).translate(self.dropped))
            form = unicodedata.normalize("NFC", self._match(unicodedata.normalize("NFD", first)))
            if len(self.known) < self.kept:
                self.known[text] = form
        return form

    def _run(self, match: re.Match[str]) -> str:
        run = match.group()
        if (form := self.known.get(run)) is None:
            form = "".join(map(self.cluster, self.clusters.findall(run)))
        return form

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        formed = self.run.sub(self._run, text)
        # a mark that followed a dropped or blank character may have come to stand behind another letter
        return unicodedata.normalize("NFC", formed)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(build_mapping())


def canonical(text: Column) -> Column:
    """The consistent form of a text."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(transducer(), na_action="ignore")

    return form(text.cast("string"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, form, raw): 256-bit digests of a text's form and of its characters. Texts that look
    the same share ``form``; exact copies share ``raw`` as well. Null texts are left out."""
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.unhex(F.sha2(canonical(F.col("text")).cast("binary"), 256)).alias("form"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("raw"))


def p10_found(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of documents that look the same and differ in characters.

    Distinct spellings are paired first and their documents brought in on equal keys after that, so that
    the work is as large as the result: of a class of exact copies and one odd spelling no copies meet.
    """
    members = cut(classes(docs))
    spellings = members.select("form", "raw").distinct()
    pairs = spellings.withColumnRenamed("raw", "raw_a").join(spellings.withColumnRenamed("raw", "raw_b"), "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    # a text has one form, so that the digest of its characters is key enough
    a, b = members.select(F.col("raw").alias("raw_a"), F.col("doc_id").alias("a")), members.select(F.col("raw").alias("raw_b"), F.col("doc_id").alias("b"))
    return pairs.join(a, "raw_a").join(b, "raw_b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()


def memberships(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, spellings, documents): each document of a class with more than one spelling;
    class_id is its smallest document."""
    c = cut(classes(docs))
    sizes = c.groupBy("form").agg(F.min("doc_id").alias("class_id"), F.count_distinct("raw").alias("spellings"), F.count_distinct("doc_id").alias("documents")).where("spellings > 1")
    return c.join(sizes, "form").select("doc_id", "class_id", "spellings", "documents").distinct()
