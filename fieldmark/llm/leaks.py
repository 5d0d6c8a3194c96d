"""Held-out evaluation passages inside a corpus: which documents hold which test items.

Method: documents and items become sequences of words (look-alike forms, letter case, mark-up and
punctuation set aside). Windows of words are embedded by CGK random walks, which turn a small edit
distance into a small Hamming distance, and hashed by bit sampling; ``REPEATS`` independent walks and
samples reach the target recall. Where a document and an item share a hash, the item is aligned with the
words around by least edits, and the longest run of its words with at most the allowed share of
replaced, missing and added ones decides.

The items, a held-out set of bounded size that is checked against ``MOST_ITEM_WORDS``, are sent to
every executor; the corpus is neither shuffled nor collected: hashing and verification happen in one
pass over the documents. A set of items over the bound is worked off in parts, one pass each.

Defined results: null texts and texts without words leak nothing; an item without words is never
found; repeated documents are each reported; a document may leak several items.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.lookalike import transducer

#: Words of a window, and words between the starts of a document's windows. Items have windows at
#: every word, so that a passage of WINDOW + STRIDE words holds a document window that starts at the
#: same word as an item window.
WINDOW, STRIDE = 16, 6
#: Sampled places of each embedding and number of independent embeddings. With up to one word in ten
#: replaced, a window keeps a sampled word with probability about 0.8 to 0.9; a passage of half an
#: item has five to fifteen windows. Measured recall is in the README.
SAMPLES, REPEATS = 10, 10
SEED = 20240607
#: A passage must hold this share of the item's words, with at most this share of words replaced.
LEAST_SHARE, MOST_REPLACED = 0.5, 0.1
#: Words by which chance may exceed the replaced share in a short passage, and share of an item by which
#: a passage may be shifted against it, which is more than those words can do.
SLACK, DRIFT = 2, 0.2
#: Windows hashed at a time, cells of the tables of one alignment, and words whose codes a worker keeps.
AT_ONCE, TABLE, KEPT = 16_384, 4_000_000, 500_000
#: Words of items that one pass holds in memory (about 100 bytes each).
MOST_ITEM_WORDS = 1_000_000

_MARKUP = re.compile(r"<[a-z/!?][^<>]*>|&(?:[a-z]{2,8}|#\d{1,6});", re.I)
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words that count for leaks."""
    text = transducer()(_MARKUP.sub(" ", text)).lower()
    return _WORD.findall(text.replace("'", "").replace("’", ""))


class _Codes(dict):
    """Codes of words, kept as they recur."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_codes = _Codes()


def codes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def sampled_hashes(sequence: np.ndarray, starts: np.ndarray, repeat: int) -> np.ndarray:
    """One hash for each window: of SAMPLES places of the window's CGK embedding.

    The walk stays on a word or goes on by a random bit of (step, word); the embedding at a step is
    the word stood on. Places are sampled among the first WINDOW steps, which a walk of expected
    half speed spends within the window.
    """
    rng = np.random.default_rng((SEED, repeat))
    steps = np.sort(rng.choice(2 * WINDOW - 4, SAMPLES, replace=False))
    salt = rng.integers(1, 2**63, 2 * WINDOW, dtype=np.uint64)
    at = np.zeros(len(starts), dtype=np.int64)
    out = np.full(len(starts), repeat + 1, dtype=np.uint64)
    last = int(steps[-1])
    for step in range(last + 1):
        inside = at < WINDOW
        word = np.where(inside, sequence[np.minimum(starts + np.minimum(at, WINDOW - 1), len(sequence) - 1)], np.uint64(0))
        if step in steps:
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
        at += (_mix(word ^ salt[step]) & np.uint64(1)).astype(np.int64)
    return out


def _costs(item: np.ndarray, doc: np.ndarray, free: bool) -> np.ndarray:
    """Least edits of ``item`` against each beginning of ``doc``, or where ``free`` against its stretches
    that end there."""
    j = np.arange(len(doc) + 1, dtype=np.int32)
    row = np.zeros_like(j) if free else j.copy()
    for word in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        np.minimum(row[:-1] + (doc != word), row[1:] + 1, out=new[1:])
        # added words along the row: running minimum of cost less place
        row = np.minimum.accumulate(new - j) + j
    return row


def _halves(item: np.ndarray, doc: np.ndarray, ends: tuple[bool, bool]) -> np.ndarray:
    """:func:`alignments` of one pair in little memory: the item is halved where the two halves' least
    costs meet. ends: whether words of the document before and behind the item are free."""
    if (len(item) + 1) * (len(doc) + 1) <= TABLE or len(item) < 2:
        return _table([item], [doc], ends)[0]
    half = len(item) // 2
    before = _costs(item[:half], doc, ends[0])
    behind = _costs(item[half:][::-1], doc[::-1], ends[1])[::-1]
    at = int((before + behind).argmin())
    return np.concatenate([_halves(item[:half], doc[:at], (ends[0], False)), _halves(item[half:], doc[at:], (False, ends[1]))])


def _table(items: list[np.ndarray], docs: list[np.ndarray], ends: tuple[bool, bool] = (True, True)) -> list[np.ndarray]:
    n, m, k = max(map(len, items)), max(map(len, docs)), len(items)
    word = np.zeros((n, k), dtype=np.uint64)
    there, real = np.zeros((k, m), dtype=np.uint64), np.zeros((k, m), dtype=bool)
    for c, (item, doc) in enumerate(zip(items, docs, strict=True)):
        word[: len(item), c] = item
        there[c, : len(doc)], real[c, : len(doc)] = doc, True
    j = np.arange(m + 1, dtype=np.int32)
    row = np.zeros((k, m + 1), dtype=np.int32) if ends[0] else np.repeat(j[None], k, 0)
    step = np.zeros((n + 1, k, m + 1), dtype=np.int8)
    step[0, :, 1:] = 0 if ends[0] else 3
    last = np.array([len(x) for x in items])
    final = np.zeros((k, m + 1), dtype=np.int32)
    final[last == 0] = row[last == 0]
    for i in range(n):
        equal = (word[i][:, None] == there) & real
        diagonal, up = row[:, :-1] + ~equal, row[:, 1:] + 1
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + 1
        np.minimum(diagonal, up, out=new[:, 1:])
        new = np.minimum.accumulate(new - j, axis=1) + j
        kind = np.where(new[:, 1:] == up, np.int8(2), np.int8(3))
        kind[new[:, 1:] == diagonal] = 1
        step[i + 1, :, 0], step[i + 1, :, 1:] = 2, kind
        row = new
        final[last == i + 1] = row[last == i + 1]
    out = []
    for c in range(k):
        cost = final[c, : len(docs[c]) + 1]
        at = int(cost.argmin()) if ends[1] else len(docs[c])
        bad = np.zeros(last[c], dtype=np.int32)
        i = int(last[c])
        while i > 0 or (at > 0 and step[0, c, at] == 3):
            s = step[i, c, at]
            if s == 3:
                # an added word spoils the item's word behind it, or the last one
                if len(bad):
                    bad[min(i, len(bad) - 1)] += 1
                at -= 1
            elif s == 2:
                bad[i - 1] += 1
                i -= 1
            else:
                bad[i - 1] += word[i - 1, c] != there[c, at - 1]
                i, at = i - 1, at - 1
        out.append(bad)
    return out


def alignments(items: list[np.ndarray], docs: list[np.ndarray]) -> list[np.ndarray]:
    """For each item and stretch of a document, how many words are replaced, missing or added at each
    word of the item, in an alignment of the whole item with the fewest such words."""
    if len(items) == 1:
        return [_halves(items[0], docs[0], (True, True))]
    return _table(items, docs)


def longest_passage(bad: np.ndarray) -> int:
    """Words of the longest run of item words of which at most the allowed share is spoilt. It begins and
    ends with a word that is not, next to which at most one of two is: so that a run does not reach
    into words that are alike by chance."""
    n = len(bad)
    good = np.r_[False, False, bad == 0, False, False]
    begins, ends = good[2 : n + 2] & (good[3 : n + 3] | good[4 : n + 4]), good[2 : n + 2] & (good[1 : n + 1] | good[:n])
    # longest a..b with upto[b] - upto[a] <= share * (b - a) + SLACK: for an end the first beginning whose
    # value suffices is the first at which the highest so far does
    value = np.concatenate([[0], np.cumsum(bad)]) - MOST_REPLACED * np.arange(n + 1)
    highest = np.maximum.accumulate(np.where(np.r_[begins, False], value, -np.inf))
    first = np.searchsorted(highest, value - SLACK - 1e-9, "left")
    lengths = np.where(np.r_[False, ends], np.arange(n + 1) - first, 0)
    return max(0, int(lengths.max()))


def _pairs(codes_: np.ndarray) -> np.ndarray:
    return _mix(codes_[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes_[1:]) if len(codes_) > 1 else codes_[:0]


class Items:
    """Test items prepared for the search: their codes and a sorted table of window hashes."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [k for k, c in items if len(c)]
        self.codes = [c for _, c in items if len(c)]
        self.pairs = [np.unique(_pairs(c)) for c in self.codes]
        sequence = np.concatenate(self.codes) if self.codes else np.zeros(0, dtype=np.uint64)
        begin = np.cumsum([0, *map(len, self.codes)])
        spans = [begin[k] + np.arange(max(1, len(c) - WINDOW + 1), dtype=np.int64) for k, c in enumerate(self.codes)]
        starts = np.concatenate(spans) if spans else np.zeros(0, dtype=np.int64)
        of = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
        hashes = np.concatenate([sampled_hashes(sequence, starts, repeat) for repeat in range(REPEATS)]) if self.codes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], np.tile(of, REPEATS)[order]
        self.place = np.tile(np.concatenate([x - x[0] for x in spans]) if spans else starts, REPEATS)[order]

    def candidates(self, sequence: np.ndarray, starts: np.ndarray, doc_of: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Distinct rows (document, item, shift) that share a hash: shift is where in the document the
        item would begin."""
        found = []
        # so many windows at a time stay in a core's cache
        for at, repeat in ((at, repeat) for at in range(0, len(starts), AT_ONCE) for repeat in range(REPEATS)):
            h = sampled_hashes(sequence, starts[at : at + AT_ONCE], repeat)
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            hit = np.flatnonzero(hi > lo)
            if len(hit):
                n = hi[hit] - lo[hit]
                flat = np.repeat(lo[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                found.append(np.stack([np.repeat(doc_of[at : at + AT_ONCE][hit], n), self.owner[flat], np.repeat(place[at : at + AT_ONCE][hit], n) - self.place[flat]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)


def least_pairs(words: int) -> float:
    """Pairs of adjacent words that an item of so many words must share with a stretch that leaks it: a
    passage of half of it has one less than its words, and each spoilt word breaks two. This settles
    chance candidates before they are aligned."""
    covered = LEAST_SHARE * words
    return covered - 1 - 2 * (MOST_REPLACED * covered + SLACK)


def stretches(found: Items, candidates: np.ndarray, docs: list[np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
    """(document, item, stretch) of the candidates: around where the item would lie, with room for what
    added and missing words can shift. Hits close to each other share a stretch."""
    out: list[tuple[int, int, np.ndarray]] = []
    last: tuple[int, int] | None = None
    spans: list[list[int]] = []

    def close() -> None:
        if last is None:
            return
        d, i = last
        for a, b in spans:
            stretch = docs[d][max(a, 0) : b]
            if np.isin(_pairs(stretch), found.pairs[i]).sum() >= least_pairs(len(found.codes[i])):
                out.append((d, i, stretch))

    for d, i, shift in candidates.tolist():
        if (d, i) != last:
            close()
            last, spans = (d, i), []
        n = len(found.codes[i])
        pad = int(DRIFT * n) + 2 * SLACK + WINDOW
        if spans and shift - pad <= spans[-1][1] - n:
            spans[-1][1] = shift + n + pad
        else:
            spans.append([shift - pad, shift + n + pad])
    close()
    return out


def verify(found: Items, candidates: np.ndarray, docs: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """(document, item, share) of the candidates that are leaks."""
    likely = sorted(stretches(found, candidates, docs), key=lambda x: (len(x[2]), x[0], x[1]))
    best: dict[tuple[int, int], int] = {}
    at = 0
    while at < len(likely):
        # stretches of like length share a table of bounded size; one too large alone goes by halves
        size, upto = 0, at
        while upto < len(likely) and (upto == at or (upto - at + 1) * (len(likely[upto][2]) + 1) * (max(size, len(found.codes[likely[upto][1]])) + 1) <= TABLE):
            size = max(size, len(found.codes[likely[upto][1]]))
            upto += 1
        some = likely[at:upto]
        for (d, i, _), bad in zip(some, alignments([found.codes[i] for _, i, _ in some], [x for _, _, x in some]), strict=True):
            best[d, i] = max(best.get((d, i), 0), longest_passage(bad))
        at = upto
    # a replaced word at the very end of a passage cannot be told from the text around it
    return [(d, i, n / len(found.codes[i])) for (d, i), n in best.items() if n and n >= LEAST_SHARE * len(found.codes[i]) - 1]


_built: dict[str, Items] = {}


def _prepared(key: str, shared) -> Items:
    """The items of one pass, prepared once a worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Items(shared.value)
    return _built[key]


def _passes(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items in parts of at most MOST_ITEM_WORDS words (or one item), read one part at a time."""
    part, size = [], 0
    for r in items.where("text is not null").groupBy("item_id").agg(F.min("text").alias("text")).orderBy("item_id").toLocalIterator():
        c = codes(words(r.text))
        if part and size + len(c) > MOST_ITEM_WORDS:
            yield part
            part, size = [], 0
        part.append((r.item_id, c))
        size += len(c)
    yield part


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share): documents that hold at least half of an item's words in one passage."""
    spark = docs.sparkSession
    out = None
    for part in _passes(items):
        shared, key = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def search(batches: Iterator[pd.DataFrame], shared=shared, key=key) -> Iterator[pd.DataFrame]:
            found = _prepared(key, shared)
            for batch in batches:
                docs_ = [(d, codes(words(t))) for d, t in zip(batch["doc_id"], batch["text"], strict=True) if t]
                docs_ = [(d, c) for d, c in docs_ if len(c)]
                if not docs_ or not found.ids:
                    continue
                sequence = np.concatenate([c for _, c in docs_])
                begin = np.cumsum([0, *[len(c) for _, c in docs_]])
                starts, doc_of, place = [], [], []
                for k, (_, c) in enumerate(docs_):
                    s = np.arange(0, max(1, len(c) - WINDOW + 1), STRIDE, dtype=np.int64)
                    starts.append(begin[k] + s)
                    doc_of.append(np.full(len(s), k))
                    place.append(s)
                at = found.candidates(sequence, np.concatenate(starts), np.concatenate(doc_of), np.concatenate(place))
                rows_ = [(docs_[k][0], found.ids[i], share) for k, i, share in verify(found, at, [c for _, c in docs_])]
                if rows_:
                    yield pd.DataFrame(rows_, columns=["doc_id", "item_id", "share"])

        got = docs.where("text is not null").select("doc_id", "text").mapInPandas(search, "doc_id long, item_id long, share double")
        out = got if out is None else out.unionByName(got)
    return out


def p8_found(leaks: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the leaks."""
    return leaks.select("doc_id", "item_id").distinct()
