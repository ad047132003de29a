"""Column functions on names, annotations, taxonomies and numbers delivered as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Substrings by which an annotation counts as one of a phage.
PHAGE_KEYWORDS = (
    "phage", "prophage", "viral", "virus", "bacteriophage", "capsid", "tail", "baseplate", "portal", "terminase", "integrase", "transposase", "recombinase",
    "holin", "lysin", "lysozyme", "endolysin", "repressor", "antirepressor", "scaffold", "head", "collar", "sheath", "tape measure", "tapemeasure",
)

#: Broad categories of an annotation; the first whose substring is there holds.
CATEGORIES = (
    ("hypothetical protein", ("hypothetical", "uncharacterized")), ("ribosomal protein", ("ribosom",)), ("tRNA related", ("trna", "t-rna")),
    ("DNA replication/recombination", ("dna polymerase", "helicase", "primase", "gyrase", "topoisomerase", "recombinase", "integrase", "transposase")),
    ("transcription", ("rna polymerase", "sigma factor", "transcription")), ("translation", ("translation", "elongation factor", "initiation factor")),
    ("membrane/transport", ("transporter", "permease", "channel", "pump", "membrane", "porin")), ("cell wall/envelope", ("cell wall", "peptidoglycan", "lipopolysaccharide", "lps")),
    ("energy metabolism", ("atp synthase", "cytochrome", "nadh", "electron transport")),
    ("metabolic enzyme", ("aminotransferase", "synthase", "synthetase", "dehydrogenase", "kinase", "phosphatase", "reductase", "oxidase")),
    ("regulatory", ("regulator", "repressor", "activator", "response regulator", "sensor")), ("stress response", ("chaperone", "heat shock", "cold shock", "stress")),
    ("phage-related", ("phage", "capsid", "tail", "portal", "terminase", "holin", "lysin", "lysozyme")), ("mobile genetic element", ("transpos", "insertion", "mobile element", "is element")),
    ("toxin-antitoxin", ("toxin", "antitoxin")), ("secretion system", ("secretion", "type ii", "type iii", "type iv", "type vi")),
)

#: Taxonomic ranks and their prefixes.
RANKS = {"d": "domain", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}


def contains_any(text: str | Column, words: tuple[str, ...] = PHAGE_KEYWORDS) -> Column:
    """Whether one of the words is in the text, in any case; false for null."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))


def category(text: str | Column, categories=CATEGORIES, missing: str = "unknown", other: str = "other") -> Column:
    """The first category one of whose substrings is in the text."""
    t = F.lower(_c(text))
    out = F.when(t.isNull() | (t == ""), missing)
    for name, words in categories:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = out.when(hit, name)
    return out.otherwise(other)


def cog_letters(cog: str | Column) -> Column:
    """The letters of a multi-valued category; '-' where it is null or empty."""
    c = F.coalesce(F.nullif(F.trim(_c(cog)), F.lit("")), F.lit("-"))
    return F.filter(F.split(c, ""), lambda x: x != "")


def cog_label(cog: str | Column, product: str | Column) -> Column:
    """The category, or HYPOTHETICAL or OTHER by the product where there is none."""
    return F.coalesce(F.nullif(F.trim(_c(cog)), F.lit("")), F.when(F.contains(F.lower(_c(product)), F.lit("hypothetical")), "HYPOTHETICAL").otherwise("OTHER"))


def taxon(text: str | Column, rank: str) -> Column:
    """The name at a rank (d, p, c, o, f, g or s) of a string d__..;p__..; Unknown where it is missing."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(text), rf"(?:^|;)\s*{rank}__([^;]*)", 1), F.lit("")), F.lit("Unknown"))


def taxonomy(text: str | Column) -> Column:
    """A struct of all ranks."""
    return F.struct(*(taxon(text, p).alias(name) for p, name in RANKS.items()))


def bare_accession(text: str | Column, version: bool = True) -> Column:
    """Without GB_ or RS_ in front and, with version=False, without the version."""
    out = F.regexp_replace(_c(text), "^(GB|RS)_", "")
    return out if version else F.regexp_replace(out, r"\.[0-9]+$", "")


def other_archive(accession: str | Column) -> Column:
    """The same accession in the other archive: GCA for GCF and the other way round."""
    a = _c(accession)
    return F.when(a.startswith("GCA_"), F.concat(F.lit("GCF_"), F.substring(a, 5, 100))).when(a.startswith("GCF_"), F.concat(F.lit("GCA_"), F.substring(a, 5, 100)))


def archive_path(accession: str | Column) -> Column:
    """Archive/three digits/three digits/three digits/accession of an accession of nine digits."""
    a = _c(accession)
    d = F.lpad(F.regexp_extract(a, r"GC[AF]_([0-9]+)", 1), 9, "0")
    return F.concat_ws("/", F.substring(a, 1, 3), F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 3), a)


def assembly_of(name: str | Column) -> Column:
    """The assembly in a file or segment name: GCA/GCF with version, else NC_ number, else what is before the first underscore."""
    n = _c(name)
    return F.coalesce(F.nullif(F.regexp_extract(n, r"(GC[AF]_[0-9]+\.[0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(n, r"(NC_[0-9]+)", 1), F.lit("")), F.split(n, "_")[0])


def file_stem(path: str | Column) -> Column:
    """A file's name without folders, endings and _genomic or _genome."""
    name = F.element_at(F.split(_c(path), "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"(\.(fa|fna|fasta|csv|tsv|json|txt))?(\.gz)?$", ""), "_(genomic|genome)$", "")


def dataset_kind(name: str | Column) -> Column:
    """What kind of data set a file holds, by its name; the first rule that fits. The words, their order and the kinds are fixed values."""
    n = F.lower(_c(name))
    has = lambda w: F.contains(n, F.lit(w))
    return (
        F.when(has("bacter"), "bacteria_only").when(has("phage") & ~has("prophage"), "phage_only").when(has("gc") & (has("control") | has("shuffle") | has("content")), "gc_control")
        .when(has("test"), "test_set").when(has("train"), "train_set").when(has("dev") | has("val"), "dev_set").otherwise("unknown")
    )


def run_name(name: str | Column) -> Column:
    """A map of the parts of a___b___ls1024___lr0.0004: letters to the number after them, the rest by place."""
    parts = F.split(_c(name), "___")
    entry = lambda p, i: F.struct(F.coalesce(F.nullif(F.regexp_extract(p, r"^([a-z]+)[0-9.]+$", 1), F.lit("")), F.concat(F.lit("part"), i.cast("string"))).alias("key"), F.coalesce(F.nullif(F.regexp_extract(p, r"^[a-z]+([0-9.]+)$", 1), F.lit("")), p).alias("value"))
    return F.map_from_entries(F.transform(parts, entry))


def as_number(text: str | Column) -> Column:
    """Text, NaN and empty to a double or null."""
    v = F.nullif(F.trim(_c(text).cast("string")), F.lit("")).try_cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


def as_label(text: str | Column) -> Column:
    """'1', '1.0' or 1 to an integer; null where it can't be read."""
    return as_number(text).cast("int")


def half_even(value: str | Column, digits: int = 3) -> Column:
    """Rounded half to even; NaN is null."""
    return F.bround(F.nanvl(_c(value), F.lit(None).cast("double")), digits)


def softmax_1(z0: str | Column, z1: str | Column) -> Column:
    """The probability of class 1 of two logits."""
    return 1 / (1 + F.exp(_c(z0) - _c(z1)))


def sigmoid(z: str | Column) -> Column:
    return 1 / (1 + F.exp(-_c(z)))


def peak(values: dict[str, str]) -> Column:
    """A struct of the greatest of several columns and the name it is under; the first on ties."""
    greatest = F.greatest(*map(F.col, values.values()))
    name = F.coalesce(*(F.when(F.col(c) == greatest, n) for n, c in values.items()))
    return F.struct(greatest.alias("value"), name.alias("name"))


def activation_summary(values: str | Column) -> Column:
    """Greatest, mean and share above 0 of an array of activations; zeros for an empty one."""
    a = _c(values)
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    return F.struct(F.coalesce(F.array_max(a).cast("double"), F.lit(0.0)).alias("max"), F.when(n > 0, mean).otherwise(0.0).alias("mean"), F.when(n > 0, F.size(F.filter(a, lambda x: x > 0)) / n).otherwise(0.0).alias("share"))


def firing(summary: str | Column, most: float = 0.5, mean: float = 0.1, share: float = 0.3) -> Column:
    """Whether the greatest, the mean or the share is above its threshold."""
    s = _c(summary)
    return (s["max"] > most) | (s["mean"] > mean) | (s["share"] > share)


def pooled(vectors: str | Column, how: str, mask: str | Column | None = None) -> Column:
    """An array of equally long vectors to one: mean (of unmasked ones), max, first or last."""
    v = _c(vectors)
    if mask is not None:
        keep = F.arrays_zip(v.alias("v"), _c(mask).alias("m"))
        v = F.transform(F.filter(keep, lambda x: x["m"] == 1), lambda x: x["v"])
    if how == "first":
        return F.element_at(v, 1)
    if how == "last":
        return F.element_at(v, -1)
    places = F.sequence(F.lit(0), F.size(F.element_at(v, 1)) - 1)
    if how == "max":
        return F.transform(places, lambda i: F.array_max(F.transform(v, lambda x: x[i].cast("double"))))
    if how == "mean":
        return F.transform(places, lambda i: F.aggregate(v, F.lit(0.0), lambda s, x: s + x[i].cast("double")) / F.size(v))
    raise ValueError("how must be mean, max, first or last")


def cell(value: str | Column, digits: int = 6) -> Column:
    """A double as text with fixed digits; empty for null."""
    return F.when(_c(value).isNotNull(), F.format_string(f"%.{digits}f", _c(value))).otherwise("")


def release_stamps(day: str | Column, back: int) -> Column:
    """Stamps like 1Jan2024 of the first days of the last months, newest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(back)), lambda i: F.date_format(F.trunc(F.add_months(_c(day), -i), "month"), "dMMMyyyy"))
