"""Problem 9: score every text for abusive, hateful or sexual language, and report rates per source.

Cumulative-link ordinal regression. A text is read in passages (sentences, in windows of WINDOW words where they
are long). Disguises are undone first: characters without width, letters of other alphabets that look alike,
digits and signs for letters, letters set apart or repeated or swapped. The sparse features of a passage are its
words, neighbouring words by twos and threes with a gap or without (hashed into BUCKETS; a word that a list of the lexicon
holds stands for the list, an unknown capitalised one for any name), the lists met in it and their pairs. One weight per
feature is shared by both thresholds: P(grade >= k) = logistic(score - cut k), grades 0 none, 1 doubtful, 2 abuse, hate or
sexual content; the expected severity is the sum of the two. A text has the severity of its worst passage.

All weights are learned here, with a prior about zero: from the seed sentences of the lexicon and from at most MAX_LABELLED
labelled texts. Reviewers judge texts, not passages: the passage with the highest score stands for a text that was
graded above 0, the others of its passages and all of the texts graded 0 are grade 0, and the fit is repeated. Reviewers
err: each row counts in so far as the last fit finds its grade plausible.

Defined cases: null and empty texts have severity 0; verdicts that are null or unknown are left out; of several
verdicts on a text the median counts; without any label the seed sentences are the model; sources are
compared trimmed and in lower case; repeated rows are scored each; an empty table gives empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.lexicon import CLASSES, GRADES, SEED_NONE, SEED_SEVERE
from windrow.llm.ordinal import fit_ordinal, logistic, severity
from windrow.llm.tables import tidy
from windrow.ship import map_arrow

#: Most labelled texts that the fit uses (those with the least hash of their id).
MAX_LABELLED = 20_000
WINDOW, STEP = 48, 24
#: Expected severity from which a text is flagged for review: doubtful or worse is likelier than not.
FLAGGED = 0.25
#: Buckets of hashed words and neighbourhoods, as a power of two.
BITS = 20
BUCKETS = 1 << BITS
#: Precision of the prior about zero, for hashed features, lists and pairs of lists; and the weight of a seed sentence.
PRECISION, SEED_WEIGHT = (3.0, 0.2, 0.4), 1.0
ROUNDS = 5
#: Share of passages above grade 0 that is assumed where there is no label.
BASE_RATE = 0.02

_NAMES = list(CLASSES)
_PAIRS = list(combinations(range(len(_NAMES)), 2))
_WORDS: dict[str, set[str]] = {}
_STEMS: dict[str, set[str]] = {}
for _name, _text in CLASSES.items():
    for _w in _text.split():
        (_STEMS if _w.endswith("*") else _WORDS).setdefault(_w.rstrip("*"), set()).add(_name)
_STEM_LENGTHS = sorted({len(s) for s in _STEMS}, reverse=True)
_HEADS = {s[:2] for s in _STEMS}
_ENTRIES = sorted({*_WORDS, *_STEMS})
#: Number of weights of a model; two cuts follow them.
SIZE = BUCKETS + len(_NAMES) + len(_PAIRS)

_NO_WIDTH = re.compile("[­͏᠎​-‏‪-‮⁠-⁤﻿]")
#: Letters of other alphabets and the Latin ones they look like.
_ALIKE = str.maketrans("аеорсхуіѕјһкмтвнԁԛԝɡαοερτυικνѵ", "aeopcxyisjhkmtbhdqwgaoeptuiknv")
#: Digits and signs and the letters they stand for.
_SIGNS = str.maketrans("@$!|013457€", "asiioieaste")
#: The readings of digits and signs, the likeliest first.
_READINGS = (_SIGNS, str.maketrans("@$!|013457€", "aslloieaste"), str.maketrans("@$!|013457€", "asiloleaste"))
_SPACED = re.compile(r" [^\W\d_] [^\W\d_] ")
_APART = re.compile(r"(?<!\w)[^\W\d_]([ ._*\-])[^\W\d_](?:\1[^\W\d_]){2,}(?!\w)")
#: Pieces that end a passage, and those that end one before a line break.
_ENDS = (re.compile(r"[.!][\"'”’)\]]*$"), re.compile(r"[.!?\"”]$"))
_FOREIGN, _FOREIGN_WORD = re.compile(r"[Ͱ-ϿЀ-ԯ]"), re.compile(r"\w*[Ͱ-ϿЀ-ԯ]\w*")
_EDGE = re.compile(r"^[^\w@$!*%#]+|[^\w@$*%#]+$")
_BASES = re.compile("[acgt]{8,}")
#: No entry is spelled with the letters of bases alone, so a nucleotide string needs no look-up.
_NO_ENTRY_OF_BASES = not any(set(e) <= set("acgt") for e in _ENTRIES)
_RUN = re.compile(r"(\w)\1{2,}")
_LETTER = re.compile(r"[^\W\d_]")
_NUMBERED = re.compile(r"([^\W\d_]+)[0-9]+")
#: What joins words to one token: all but letters, apostrophes and the signs that stand for letters or hide them.
_JOINT = re.compile(r"[^\w'@$!|€*%#]+")
_ODD = re.compile(r"[^\w'-]")
#: Signs that the readings differ in.
_DOUBTFUL = re.compile(r"[!|1]")
_SIGN = re.compile(r"[@$!|0-9€]")
_SAME = re.compile(r"(.)\1+")


def _entry(word: str) -> str | None:
    """The lexicon entry that a plain word belongs to."""
    if word in _WORDS:
        return word
    if word[:2] not in _HEADS:
        return None
    for n in _STEM_LENGTHS:
        if n <= len(word) and word[:n] in _STEMS:
            return word[:n]
    return None


_SINGLE = {_SAME.sub(r"\1", w): w for w in reversed(_ENTRIES) if len(w) > 3}


def _swaps(entry: str) -> Iterator[str]:
    for i in range(len(entry) - 1):
        if entry[i] != entry[i + 1]:
            yield entry[:i] + entry[i + 1] + entry[i] + entry[i + 2 :]


#: Entries of more than four letters by the forms in which two neighbouring letters have changed places.
_SWAPPED_WORDS = {form: e for e in reversed(_ENTRIES) if len(e) > 4 for form in _swaps(e)}
_SWAPPED_STEMS = {form: e for form, e in _SWAPPED_WORDS.items() if e in _STEMS}
_SWAPPED_HEADS = {form[:2] for form in _SWAPPED_STEMS} | _HEADS
_LONG_STEM_LENGTHS = [n for n in _STEM_LENGTHS if n > 4]


def _swapped(word: str) -> str | None:
    """The entry of a word in which two neighbouring letters have changed places."""
    if found := _SWAPPED_WORDS.get(word):
        return found
    if word[:2] not in _SWAPPED_HEADS:
        return None
    for n in _LONG_STEM_LENGTHS:
        if n < len(word):
            head = word[:n]
            if head in _SWAPPED_STEMS:
                return _SWAPPED_STEMS[head]
            if (e := head[:-1] + word[n]) in _STEMS:
                return e
    return None


def _known(word: str) -> str | None:
    """The same for a word in disguise: repeated, swapped or hidden letters."""
    if found := _entry(word):
        return found
    if _RUN.search(word):
        for to in (r"\1", r"\1\1"):
            if found := _entry(_RUN.sub(to, word)):
                return found
        single = _SAME.sub(r"\1", word)[:20]  # no entry is longer
        for n in range(len(single), 3, -1):
            if (found := _SINGLE.get(single[:n])) and (n == len(single) or found in _STEMS):
                return found
    if 4 < len(word) < 15 and word.isalpha():
        return _swapped(word)
    return None


def _undone(token: str) -> tuple[str, str] | None:
    """The word, with its entry, that a token is if its digits and signs stand for letters."""
    for reading in _READINGS if _DOUBTFUL.search(token) else _READINGS[:1]:
        guess = token.translate(reading)
        if not guess.isalnum():
            guess = _ODD.sub("", guess)
        if found := _known(guess):
            return guess, found
    return None


def _unhidden(token: str) -> str | None:
    """The entry of a word in which one letter is hidden by one or two signs."""
    shape = re.escape(token.translate(str.maketrans("@$!", "asi")))
    shape = re.sub(r"(?:\\?[*%#])+", ".{1,2}", shape)
    if len(token.replace("*", "").replace("%", "").replace("#", "")) >= 3:
        for entry in _ENTRIES:
            if len(entry) > 3 and re.fullmatch(shape + (r"" if entry in _WORDS else r"?"), entry):
                return entry
    return None


def _part(token: str) -> tuple[tuple[str, str | None], ...]:
    """The words of a token that no joint divides."""
    if token.isalpha():
        return ((token, _known(token)),)
    if re.search(r"[*%#]", token) and _LETTER.search(token):
        found = _unhidden(token)
        return ((found or token, found),)
    if (numbered := _NUMBERED.fullmatch(token)) and (found := _entry(numbered[1])):  # a word with a number
        return ((token, found),)
    if _SIGN.search(token):
        if word := _undone(token):
            return (word,)
        if numbered:
            return ((token, None),)
        token = token.translate(_SIGNS)
    out = []
    for part in re.split(r"[^\w']+", token):
        if part:
            out.append((part, _known(part.split("'")[0]) if part not in ("other's",) else _entry(part)))
    return tuple(out)


@lru_cache(maxsize=200_000)
def words(raw: str) -> tuple[tuple[str, str | None], ...]:
    """The words of a piece of text without white space, each with its lexicon entry or None.

    Joined words are parted before disguises are undone, so each is read by itself, however long the whole is.
    """
    token = raw.lower()
    if not (token.isalpha() or token.isalnum() and token.isascii()):
        token = _EDGE.sub("", token)
    if not token or not _LETTER.search(token):
        return ()
    if _NO_ENTRY_OF_BASES and _BASES.fullmatch(token):
        return ((token, None),)
    if token.endswith("-proof"):
        return (("proof", "proof"),)
    if token.isalpha():
        return ((token, _known(token)),)
    token = together(token)
    token = token.replace("’", "'")
    sections = [x for x in _JOINT.split(token) if x]
    if len(sections) == 1 and "_" not in token:
        return _part(sections[0])
    for reading in (None, *_READINGS):  # entries that are joined words themselves
        whole = token.translate(reading) if reading else token
        if whole in _WORDS:
            return ((whole, whole),)
    out = []
    for section in sections:
        named = [x for x in section.split("_") if x]
        for part in named:
            # between underscores a number is a number
            out.extend(_part(part) if len(named) == 1 or _LETTER.search(part) else ((part, None),))
    if _SIGN.search(token) and (word := _undone(token)) and word[1] not in {entry for _, entry in out}:
        out.append(word)  # the joint may stand within a word
    return tuple(out)


def plain(text: str) -> str:
    """The text with its disguises undone as far as they concern characters and letters set apart by spaces."""
    if not text.isascii():
        text = _NO_WIDTH.sub("", unicodedata.normalize("NFKC", text))
        if _FOREIGN.search(text):
            text = _FOREIGN_WORD.sub(lambda m: m[0].lower().translate(_ALIKE), text)
    return together(text) if _SPACED.search(text) else text


def together(text: str) -> str:
    """The text with letters that were set apart joined again."""
    return _APART.sub(lambda m: re.sub(r"[ ._*\-]", "", m[0]), text)


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHIFT = np.uint64(64 - BITS)
#: Characters and words that are read together, and pieces that a reader remembers.
CHARACTERS, BLOCK, REMEMBERED = 2_000_000, 200_000, 400_000
#: Stands for a line break among the pieces.
_BREAK = "\ue000"


def _fold(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits to buckets."""
    return ((x ^ (x >> np.uint64(29))) * _M2 >> _SHIFT).astype(np.int64)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    upto = np.cumsum(lengths)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - lengths), lengths)


class Reader:
    """Pieces of text to the numbers of their words; hashes and lists of the numbers are kept in an array. Number 0 is the edge of a passage."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[str, tuple[tuple[int, ...], int]] = {}
        self.number: dict[tuple[str, str | None, bool], int] = {}
        self.columns: list[tuple[int, int, int]] = [(0, xxhash.xxh3_64_intdigest("edge"), 0)]

    def look_up(self, piece: str) -> tuple[tuple[int, ...], int]:
        """The numbers of the words of a piece; and whether it ends a passage (1 always, 2 before a line break)."""
        known = self.pieces.get(piece)
        if known is None:
            name = piece[:1].isupper() and piece[1:].islower()
            out = []
            for word, entry in words(piece):
                key = (word, entry, name and entry is None)
                at = self.number.get(key)
                if at is None:
                    at = self.number[key] = len(self.columns)
                    lists = (_WORDS.get(entry) or _STEMS[entry]) if entry else ()
                    kind = min(map(_NAMES.index, lists)) if lists else -1
                    stands = f"<{_NAMES[kind]}>" if lists else "<name>" if key[2] else word
                    self.columns.append((xxhash.xxh3_64_intdigest(entry or word), xxhash.xxh3_64_intdigest(stands), sum(1 << _NAMES.index(c) for c in lists)))
                out.append(at)
            known = self.pieces[piece] = (tuple(out), sum(k for k, end in zip((1, 2), _ENDS, strict=True) if end.search(piece)))
        return known


class Passages:
    """The passages of some texts: sentences, long ones in overlapping windows. owner is the text of each passage."""

    def __init__(self, reader: Reader, texts: list[str]) -> None:
        if len(reader.pieces) > REMEMBERED:
            reader.forget()
        lists = pc.utf8_split_whitespace(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", f" {_BREAK} "))
        number = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = pc.list_flatten(lists)
        encoded = pieces.dictionary_encode()
        code, self.unlike = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary.to_pylist()
        found = [reader.look_up(x) for x in self.unlike]
        ends = np.array([f[1] for f in found], np.int8)
        stop = self.unlike.index(_BREAK) if _BREAK in self.unlike else -1
        text = np.repeat(np.arange(len(texts)), number)
        breaks = np.cumsum(code == stop)
        kept = np.flatnonzero((code != stop) & (code >= 0) & (np.array([bool(x) for x in self.unlike] or [True])[code] if len(code) else np.zeros(0, bool)))
        self.code, text, breaks = code[kept], text[kept], breaks[kept]
        n = len(kept)
        first = np.ones(n, bool)
        if n > 1:
            gap, end = np.diff(breaks), ends[self.code[:-1]]
            first[1:] = (text[1:] != text[:-1]) | (end & 1 > 0) | ((end & 2 > 0) & (gap > 0)) | (gap > 1)
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, n))
        # windows of long passages
        count = np.where(lengths > WINDOW, -(-(lengths - STEP) // STEP), 1)
        at = _ranges(np.zeros(len(count), np.int64), count) * STEP
        self.start = np.repeat(starts, count) + at
        self.length = np.minimum(np.repeat(lengths, count) - at, np.where(np.repeat(count, count) > 1, WINDOW, np.repeat(lengths, count)))
        self.owner = text[self.start]
        # a capital at the beginning is no name
        begins = self.code[self.start]
        lower = {}
        for c in np.unique(begins).tolist():
            piece = self.unlike[c]
            if piece[:1].isupper() and piece[1:].islower():
                lower[c] = len(found)
                found.append(reader.look_up(piece.lower()))
        moved = np.arange(len(self.unlike))
        for c, to in lower.items():
            moved[c] = to
        self._begins = moved[begins] if len(begins) else begins
        self._sizes = np.array([1, *(len(f[0]) for f in found)])
        self._from = np.cumsum(self._sizes) - self._sizes
        self._values = np.fromiter(chain((0,), chain.from_iterable(f[0] for f in found)), np.int64, int(self._sizes.sum()))
        self.table = np.array(reader.columns, np.uint64)

    def numbers(self, which: slice) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of some passages, each with an edge before it; and their lengths with the edge."""
        start, length = self.start[which], self.length[which]
        code = self.code[_ranges(start - 1, length + 1)] + 1  # the piece before stands where the edge will be
        at = np.cumsum(length + 1) - (length + 1)
        code[at] = 0
        code[at + 1] = self._begins[which] + 1
        sizes = self._sizes[code]
        flat = self._values[_ranges(self._from[code], sizes)]
        return flat, np.add.reduceat(sizes, at) if len(at) else sizes

    def slices(self) -> Iterator[slice]:
        """Slices of passages of about BLOCK words."""
        cuts = np.searchsorted(np.cumsum(self.length), np.arange(0, self.length.sum() + BLOCK, BLOCK), side="right")
        for a, b in zip(cuts, [*cuts[1:], len(self.length)], strict=True):
            if b > a:
                yield slice(int(a), int(b))

    def text(self, passage: int) -> str:
        at = self.start[passage]
        return " ".join(self.unlike[c] for c in self.code[at : at + self.length[passage]])


def _sparse(table: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of passages: hashed features and the passage of each; and the lists met, a row of zeros and ones a passage."""
    at = np.repeat(np.arange(len(lengths)), lengths)
    own, stand, lists = table[flat, 0], table[flat, 1], table[flat, 2]
    inner = flat != 0
    edge = table[0, 1]
    next1, next2 = np.append(stand[1:], edge), np.append(stand[2:], [edge, edge])[: len(flat)]
    within = np.append(inner[1:], False)  # the next word is of the same passage
    two = _fold(stand * _M1 + next1 * _M3)
    gap = _fold(stand * _M3 + next2 * _M1 + _M2)
    three = _fold((stand * _M1 + next1) * _M3 + next2 * _M2)
    features = np.concatenate([_fold(own[inner]), two, gap[within], three[within]])
    passage = np.concatenate([at[inner], at, at[within], at[within]])
    met = np.bitwise_or.reduceat(lists, np.cumsum(lengths) - lengths)
    met = (met[:, None] >> np.arange(len(_NAMES), dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.float32)
    return features, passage, met


_FIRST_OF_PAIR, _SECOND_OF_PAIR = (np.array(x) for x in zip(*_PAIRS, strict=True))


def scores(pages: Passages, w: np.ndarray) -> np.ndarray:
    """The score of each passage."""
    pairs = np.zeros((len(_NAMES), len(_NAMES)))
    pairs[_FIRST_OF_PAIR, _SECOND_OF_PAIR] = w[BUCKETS + len(_NAMES) : SIZE]
    out = [np.zeros(0)]
    for part in pages.slices():
        features, passage, met = _sparse(pages.table, *pages.numbers(part))
        found = np.bincount(passage, w[features], len(met))
        out.append(found + met @ w[BUCKETS : BUCKETS + len(_NAMES)] + ((met @ pairs) * met).sum(axis=1))
    return np.concatenate(out)


def features(pages: Passages) -> list[np.ndarray]:
    """The features of each passage, as often as they are there."""
    out: list[np.ndarray] = []
    for part in pages.slices():
        hashed, passage, met = _sparse(pages.table, *pages.numbers(part))
        row, which = np.nonzero(met)
        pair_row, pair = np.nonzero(met[:, _FIRST_OF_PAIR] * met[:, _SECOND_OF_PAIR])
        every = np.concatenate([hashed, BUCKETS + which, BUCKETS + len(_NAMES) + pair])
        owner = np.concatenate([passage, row, pair_row])
        order = np.argsort(owner, kind="stable")
        out += np.split(every[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(met)))[:-1])
    return out


def read(reader: Reader, text: str) -> list[np.ndarray]:
    """The features of the passages of a text."""
    return features(Passages(reader, [plain(text)]))


Labelled = tuple[float, list[np.ndarray]]


def seeds() -> list[Labelled]:
    """The seed sentences as labelled texts."""
    reader = Reader()
    return [(grade, read(reader, x)) for grade, text in ((2.0, SEED_SEVERE), (0.0, SEED_NONE)) for x in re.split(r"\s*[|\n]\s*", text) if x]


def _fitted(flat: np.ndarray, row: np.ndarray, grades: np.ndarray, weights: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    """Weights and cuts from the features of rows, the row of each, and the rows' grades and weights; rows of weight 0 don't count. Features that no graded row has stay zero."""
    live = weights > 0
    used = np.unique(flat[(live & (grades > 0))[row]])
    place = np.full(SIZE, -1, np.int32)
    place[used] = np.arange(len(used))
    at = place[flat]
    kept = (at >= 0) & live[row]
    number = np.cumsum(live) - 1  # of the rows that count
    ends = np.concatenate([[0], np.cumsum(np.bincount(number[row[kept]], minlength=int(live.sum())))])
    precision = np.array(PRECISION)[np.searchsorted([BUCKETS, BUCKETS + len(_NAMES)], used, side="right")]
    begin = None
    if start is not None:
        begin = np.concatenate([start[used], [start[-2], np.log(max(start[-1] - start[-2], 1e-2))]])
    w = fit_ordinal(at[kept], ends, grades[live], weights[live], precision, begin)
    out = np.zeros(SIZE + 2)
    out[used] = w[:-2]
    out[-2:] = w[-2:]
    return out


def fit(texts: list[Labelled], rounds: int = ROUNDS) -> np.ndarray:
    """The model from labelled texts, each a grade and the features of its passages; the seeds are added."""
    fixed = seeds()
    every = [(g, lists) for g, lists in fixed + texts if lists]
    grade = np.array([g for g, _ in every])
    size = np.array([len(lists) for _, lists in every])
    lists = list(chain.from_iterable(lists for _, lists in every))
    flat = np.concatenate(lists)
    row = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    first = np.cumsum(size) - size  # the first row of each text
    graded, seed = np.repeat(grade, size), np.arange(len(lists)) < sum(len(x) for _, x in fixed)
    w = _fitted(flat, row, graded.astype(int), np.where(seed, SEED_WEIGHT, 0.0), None)
    if seed.all():  # every second seed is severe, not every second passage
        some = int((graded > 0).sum())
        w[-2:] += np.log((1 - BASE_RATE) / BASE_RATE) - np.log((len(lists) - some) / some)
        return w
    for _ in range(rounds):
        found = severity(np.bincount(row, w[flat], len(lists)), w[-2:]) / 2
        worst = np.zeros(len(lists), bool)
        order = np.lexsort((-np.arange(len(lists)), found, np.repeat(np.arange(len(size)), size)))
        worst[order[first + size - 1]] = True
        worst &= graded > 0
        rows = np.where(worst, np.where(graded >= 1.5, 2, 1), 0)
        sure = np.where(worst, np.maximum(0.05, found), np.where((graded == 0) | (found < 0.25), np.maximum(0.05, 1 - found), 0.0))
        w = _fitted(flat, row, np.where(seed, graded.astype(int), rows), np.where(seed, SEED_WEIGHT, sure), w)
    return w


@lru_cache(maxsize=1)
def untaught() -> np.ndarray:
    """The model of the seed sentences alone."""
    return fit([])


def _labelled(documents: DataFrame, labels: DataFrame) -> list[Labelled]:
    grade = F.lit(None).cast("double")
    for verdict, g in GRADES.items():
        grade = F.when(tidy("verdict") == verdict, F.lit(float(g))).otherwise(grade)
    graded = labels.select(F.col("doc_id").cast("bigint").alias("id"), grade.alias("grade")).filter("id IS NOT NULL AND grade IS NOT NULL")
    graded = graded.groupBy("id").agg(F.median("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")  # at most MAX_LABELLED rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            found = [read(reader, text or "") for text in batch.column("text").to_pylist()]
            ends = [np.cumsum([0, *map(len, x)]).astype(np.int32).tobytes() for x in found]
            flat = [np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array(ends, pa.binary()), pa.array(flat, pa.binary())], names=["id", "grade", "ends", "flat"])

    rows = map_arrow(texts, run, "id bigint, grade double, ends binary, flat binary").collect()
    out = []
    for r in sorted(rows, key=lambda r: (r["id"], r["grade"], bytes(r["flat"]))):
        ends = np.frombuffer(r["ends"], np.int32)
        out.append((r["grade"], np.split(np.frombuffer(r["flat"], np.int32), ends[1:-1]) if len(ends) > 1 else []))
    return out


def train(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """The fitted model of documents(doc_id, text) and labels(doc_id, verdict)."""
    return fit(_labelled(documents, labels))


_SCORED = "doc_id bigint, source string, severity double, doubtful double, severe double, passage string, passages int"


def worst_passages(reader: Reader, texts: list[str | None], w: np.ndarray) -> tuple[np.ndarray, list[str | None], np.ndarray]:
    """Of each text: the score of its worst passage (-inf without any), that passage, and the number of passages."""
    best, where, number = np.full(len(texts), -np.inf), [None] * len(texts), np.zeros(len(texts), np.int32)
    upto = np.cumsum([len(t or "") for t in texts])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHARACTERS)))
        pages = Passages(reader, [plain(t or "") for t in texts[i:j]])
        found = scores(pages, w)
        number[i:j] = np.bincount(pages.owner, minlength=j - i)
        order = np.lexsort((-np.arange(len(found)), found, pages.owner))
        for k in order[np.flatnonzero(np.diff(pages.owner[order], append=-1))].tolist():
            best[i + pages.owner[k]], where[i + pages.owner[k]] = found[k], pages.text(k)
        i = j
    return best, where, number


def score_documents(documents: DataFrame, labels: DataFrame | None = None, model: np.ndarray | None = None) -> DataFrame:
    """(doc_id, source, severity, doubtful, severe, passage, passages, flagged) of every row of documents(doc_id, source, text).

    doubtful and severe are the probabilities to reach grades 1 and 2; passage is the worst one, as it was read.
    """
    w = model if model is not None else train(documents, labels) if labels is not None else untaught()
    places, cuts = np.flatnonzero(w[:-2]), w[-2:]
    values = w[places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, reader = np.zeros(SIZE), Reader()
        weights[places] = values
        for batch in batches:
            s, worst, number = worst_passages(reader, batch.column("text").to_pylist(), weights)
            none = ~np.isfinite(s)
            s[none] = 0
            p = logistic(s[:, None] - cuts[None, :])
            p[none] = 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(worst, pa.string()), pa.array(number, pa.int32())], names=[c.split()[0] for c in _SCORED.split(", ")])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("id"), tidy("source").alias("source"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, _SCORED).withColumn("flagged", F.col("severity") >= FLAGGED)


def severity_rates(scored: DataFrame) -> DataFrame:
    """Per source: texts, flagged texts, their share and the mean severity."""
    return scored.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("severity").alias("mean_severity"))
