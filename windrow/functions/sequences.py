"""Column functions on nucleotide strings: composition, complements, k-mers, windows, tokens, padding.

All are built-in expressions. Sequences are used as given; upper() them first where case should not matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the token contracts.
CLS, SEP, UNK = 2, 3, 1
SPECIALS = 5


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_bases(seq: str | Column) -> Column:
    """Letters only, in upper case."""
    return F.upper(F.regexp_replace(_c(seq), r"[^A-Za-z]", ""))


def gc_content(seq: str | Column) -> Column:
    """Share of G and C; 0 for an empty sequence, null for null."""
    s = _c(seq)
    return F.when(F.length(s) > 0, F.regexp_count(F.upper(s), F.lit("[GC]")) / F.length(s)).when(s.isNotNull(), 0.0)


def reverse_complement(seq: str | Column) -> Column:
    """Reversed with A-T and C-G swapped; case and other letters stay."""
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


#: Words that are cut from one part of a sequence: finding a place in a string takes time in proportion to it.
_PART = 128


def kmers(seq: str | Column, k: int, shift: int = 1, offset: int = 0) -> Column:
    """The k-mers from the offset on, every shift letters; an empty array where the sequence is too short.

    The sequence is cut into parts first and the words from these, so the time doesn't grow with the square of the length.
    """
    if not 0 <= offset < max(1, shift):
        raise ValueError("the offset must be less than the shift")
    s = _c(seq)
    many = F.floor((F.length(s) - k - offset) / F.lit(shift)) + 1
    parts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((many - 1) / F.lit(_PART))), lambda b: F.struct(
        F.substring(s, (b * (_PART * shift) + (offset + 1)).cast("int"), F.lit((_PART - 1) * shift + k)).alias("t"), F.least(F.lit(_PART).cast("bigint"), many - b * _PART).cast("int").alias("n")))
    words = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda j: F.substring(p["t"], j * shift + 1, F.lit(k)))))
    return F.when(many >= 1, words).when(s.isNotNull(), F.array().cast("array<string>"))


def kmer_number(word: Column) -> Column:
    """The place of a word over A, C, G, T in lexical order; null for other letters."""
    digits = F.translate(word, "ACGT", "0123")
    return F.when(word.rlike("^[ACGT]+$"), F.conv(digits, 4, 10).cast("int"))


def all_kmers(spark, k: int):
    """(kmer, number) of all words of length k in lexical order, after the special tokens."""
    n = 4**k
    digits = F.lpad(F.conv(F.col("id").cast("string"), 10, 4), k, "0")
    return spark.range(n).select(F.translate(digits, "0123", "ACGT").alias("kmer"), (F.col("id") + SPECIALS).cast("int").alias("number"))


def tokenize(seq: str | Column, k: int, shift: int = 1, offset: int = 0, max_unknown: float = 0.9, max_length: int | None = None) -> Column:
    """Token numbers of the k-mers of one offset between the class and separator tokens.

    Unknown k-mers have the unknown token; where their share is above max_unknown, or there is no k-mer, only the two
    outer tokens are left. A sequence longer than max_length is an error.
    """
    words = kmers(seq, k, shift, offset)
    ids = F.transform(words, lambda w: F.coalesce(kmer_number(w) + SPECIALS, F.lit(UNK)))
    unknown = F.size(F.filter(ids, lambda i: i == UNK))
    body = F.when((F.size(ids) == 0) | (unknown > F.size(ids) * F.lit(max_unknown)), F.array().cast("array<int>")).otherwise(ids)
    out = F.concat(F.array(F.lit(CLS)), body, F.array(F.lit(SEP)))
    if max_length is not None:
        out = F.when(F.length(_c(seq)) > max_length, F.raise_error(F.lit(f"sequence longer than {max_length}")).cast("array<int>")).otherwise(out)
    return out


def tokenize_offsets(seq: str | Column, k: int, shift: int, **options) -> Column:
    """One token vector per offset below shift."""
    return F.array(*(tokenize(seq, k, shift, o, **options) for o in range(shift)))


def pad(ids: str | Column, length: int) -> Column:
    """Zeros to the right up to length; longer vectors are cut."""
    a = _c(ids)
    return F.slice(F.concat(a, F.array_repeat(F.lit(0), length)), 1, length)


def attention_mask(ids: str | Column) -> Column:
    """0 at padding and unknown tokens (0 and 1), else 1."""
    return F.transform(_c(ids), lambda i: F.when(i.isin(0, 1), 0).otherwise(1))


def decode(ids: str | Column, k: int) -> Column:
    """The sequence of overlapping k-mer tokens with shift 1: the first word, then the last letter of each."""
    a = F.filter(_c(ids), lambda i: i >= SPECIALS)
    words = F.transform(a, lambda i: F.translate(F.lpad(F.conv((i - SPECIALS).cast("string"), 10, 4), k, "0"), "0123", "ACGT"))
    return F.when(F.size(words) > 0, F.concat(words[0], F.array_join(F.transform(F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1)), lambda w: F.right(w, F.lit(1))), ""))).otherwise("")


def tokens_of_length(bases: str | Column, k: int, shift: int = 1) -> Column:
    """How many k-mer tokens a sequence of so many bases has, with the two outer ones."""
    n = _c(bases)
    return F.when(n >= k, F.floor((n - k) / F.lit(shift)) + 3).otherwise(2)


def length_of_tokens(tokens: str | Column, k: int, shift: int = 1) -> Column:
    """The longest sequence that so many tokens (with the outer two) hold."""
    return (_c(tokens) - 3) * shift + k + (shift - 1)


#: Numbers of single letters, of others, and of the padding that N becomes.
LETTERS, OTHER_LETTER, PAD_LETTER = {"A": 7, "C": 8, "G": 9, "T": 10, "N": 11}, 6, 4


def letter_tokens(seq: str | Column, length: int | None = None, pad_n: bool = False) -> Column:
    """One number per letter; padded on the left or cut to length; with pad_n, N is padding."""
    s = F.upper(_c(seq))
    ids = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.coalesce(*(F.when(c == k, v) for k, v in LETTERS.items()), F.lit(OTHER_LETTER)))
    if pad_n:
        ids = F.transform(ids, lambda i: F.when(i == LETTERS["N"], PAD_LETTER).otherwise(i))
    if length is not None:
        ids = F.slice(ids, 1, length)
        ids = F.concat(F.array_repeat(F.lit(PAD_LETTER), F.greatest(F.lit(0), length - F.size(ids))), ids)
    return ids


def framed_letters(seq: str | Column) -> Column:
    """0, then 1..4 for A, T, C, G (others 1), then 5."""
    letters = F.transform(F.filter(F.split(F.upper(_c(seq)), ""), lambda c: c != ""), lambda c: F.when(c == "T", 2).when(c == "C", 3).when(c == "G", 4).otherwise(1))
    return F.concat(F.array(F.lit(0)), letters, F.array(F.lit(5)))


def sliding_windows(length: str | Column, window: int, stride: int, least: int = 500) -> Column:
    """Array of (start, end), 0-based half-open: ends are clipped, tails under least dropped, none begins after the end was reached."""
    n = _c(length)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1, F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    kept = F.filter(starts, lambda p: (F.least(p + window, n) - p >= least) & ((p == 0) | (p - stride + window < n)))
    return F.transform(kept, lambda p: F.struct(p.alias("start"), F.least(p + window, n.cast("bigint")).alias("end")))


def contiguous_segments(length: str | Column, size: int, least: int = 0) -> Column:
    """Array of disjoint (start, end) of size bases, the last shorter; those under least dropped."""
    n = _c(length)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1, F.lit(size).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    cut = F.transform(starts, lambda p: F.struct(p.alias("start"), F.least(p + size, n.cast("bigint")).alias("end")))
    return F.filter(cut, lambda x: x["end"] - x["start"] >= least)


def subsequence(seq: str | Column, start: str | Column, end: str | Column, strand: str | Column | None = None) -> Column:
    """1-based inclusive part of a sequence, reverse-complemented on the minus strand."""
    part = F.substring(_c(seq), _c(start), _c(end) - _c(start) + 1)
    return part if strand is None else F.when(_c(strand) == "-", reverse_complement(part)).otherwise(part)


def shuffled_letters(seq: str | Column, key: str | Column, seed: int) -> Column:
    """The letters of a sequence in an order that a hash of key, seed and place gives; the composition stays."""
    letters = F.filter(F.split(_c(seq), ""), lambda c: c != "")
    placed = F.transform(letters, lambda c, i: F.struct(F.md5(F.concat_ws("|", _c(key), F.lit(str(seed)), i.cast("string"))).alias("h"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["c"]), "")


def wrapped(seq: str | Column, width: int = 80) -> Column:
    """A line break after every width letters, none at the end."""
    return F.regexp_replace(F.regexp_replace(_c(seq), f"(.{{{width}}})", "$1\n"), "\n$", "")


def base_places(seq: str | Column, base: str) -> Column:
    """0-based places of a letter."""
    letters = F.split(_c(seq), "")
    return F.filter(F.transform(letters, lambda c, i: F.when(c == base, i)), lambda x: x.isNotNull())


def rectangular(df, ids: str, name: str = "padded"):
    """df with its token vectors padded to the longest of all; one pass finds that length."""
    longest = df.agg(F.coalesce(F.max(F.size(ids)), F.lit(0))).first()[0]
    return df.withColumn(name, pad(ids, max(1, longest)))
