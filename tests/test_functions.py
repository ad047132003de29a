"""Column functions on single values."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from windrow.functions import annotations as an
from windrow.functions import sequences as sq


@pytest.fixture(scope="module")
def one(spark):
    return lambda column, **values: spark.createDataFrame([Row(**(values or {"x": 1}))]).select(column.alias("v")).first()["v"]


def test_composition(one):
    assert one(sq.gc_content(F.lit("GgCcAT"))) == pytest.approx(4 / 6)
    assert one(sq.gc_content(F.lit(""))) == 0 and one(sq.gc_content(F.lit(None).cast("string"))) is None
    assert one(sq.reverse_complement(F.lit("ATGCNacgtX"))) == "XacgtNGCAT"


def test_windows(one):
    pairs = lambda c: [tuple(x) for x in one(c)]
    assert pairs(sq.sliding_windows(F.lit(10), 4, 2, 1)) == [(0, 4), (2, 6), (4, 8), (6, 10)]
    assert pairs(sq.sliding_windows(F.lit(0), 4, 2, 1)) == []
    for n in range(1, 40):
        for w, s, m in ((4, 2, 1), (5, 5, 3), (3, 7, 2), (8, 3, 8)):
            want, p = [], 0
            while p < n:
                e = min(p + w, n)
                if e - p < m:
                    break
                want.append((p, e))
                if e == n:
                    break
                p += s
            assert pairs(sq.sliding_windows(F.lit(n), w, s, m)) == want
    cut = lambda s, least, size: [s[a:b] for a, b in pairs(sq.contiguous_segments(F.length(F.lit(s)), size, least))]
    assert cut("TAGAA", 0, 4) == ["TAGA", "A"] and cut("TAGAATAG", 5, 6) == ["TAGAAT"] and cut("TAGAATAG", 3, 4) == ["TAGA", "ATAG"] and cut("TAG", 0, 9) == ["TAG"]


def test_tokens(one):
    t = lambda s, *a, **k: one(sq.tokenize(F.lit(s), *a, **k))
    assert t("TCTTTGCTAAG", 5) == [2, 900, 515, 1022, 1004, 929, 629, 455, 3]
    assert t("AATCAAGGAATTATTATCGTT", 6, 2) == [2, 213, 3343, 165, 2580, 248, 3905, 978, 3296, 3]
    assert t("UUUUUTCTTT", 5, max_unknown=0.2) == [2, 3] and t("", 5) == [2, 3]
    with pytest.raises(ValueError):
        sq.kmers(F.lit("ACGT"), 3, 2, 2)
    with pytest.raises(Exception, match="longer"):
        t("ACGTACGT", 3, max_length=5)
    assert one(sq.decode(sq.tokenize(F.lit("TCTTTGCTAAG"), 5), 5)) == "TCTTTGCTAAG"
    assert one(sq.pad(F.array(F.lit(2), F.lit(7)), 4)) == [2, 7, 0, 0]
    assert one(sq.attention_mask(F.array(F.lit(2), F.lit(1), F.lit(0)))) == [1, 0, 0]
    assert one(sq.letter_tokens(F.lit("AcNx"), 6)) == [4, 4, 7, 8, 11, 6] and one(sq.letter_tokens(F.lit("NA"), None, True)) == [4, 7]
    assert one(sq.framed_letters(F.lit("ATCGN"))) == [0, 1, 2, 3, 4, 1, 5]
    n = one(sq.tokens_of_length(F.lit(11), 5))
    assert n == 9 and one(sq.length_of_tokens(F.lit(n), 5)) == 11
    assert one(F.size(sq.tokenize_offsets(F.lit("ACGTACGT"), 4, 2))) == 2


def test_other_sequence_functions(one):
    assert one(sq.wrapped(F.lit("ACGTACGT"), 4)) == "ACGT\nACGT"
    assert sorted(one(sq.shuffled_letters(F.lit("AACGT"), F.lit("k"), 1))) == list("AACGT")
    assert one(sq.subsequence(F.lit("ACGTT"), F.lit(2), F.lit(4), F.lit("-"))) == "ACG"
    assert one(sq.base_places(F.lit("GATTA"), "T")) == [2, 3]
    assert one(sq.clean_bases(F.lit(" ac-g\nT1"))) == "ACGT"


def test_names(one):
    text = "d__Bacteria;p__Bacillota;c__Bacilli;o__;f__X;g__Bacillus;s__Bacillus subtilis"
    assert one(an.taxon(F.lit(text), "g")) == "Bacillus" and one(an.taxon(F.lit(text), "o")) == "Unknown"
    assert one(an.taxonomy(F.lit(text)))["species"] == "Bacillus subtilis"
    assert one(an.bare_accession(F.lit("GB_GCA_1.2"))) == "GCA_1.2" and one(an.bare_accession(F.lit("RS_GCF_1.2"), False)) == "GCF_1"
    assert one(an.other_archive(F.lit("GCA_000001.1"))) == "GCF_000001.1"
    assert one(an.archive_path(F.lit("GCF_000123456.1"))) == "GCF/000/123/456/GCF_000123456.1"
    assert [one(an.assembly_of(F.lit(x))) for x in ("GCA_12.1_seg", "x_NC_0012.3", "abc_def")] == ["GCA_12.1", "NC_0012", "abc"]
    assert one(an.file_stem(F.lit("/a/b/GCF_1.1_genomic.fna.gz"))) == "GCF_1.1"
    assert [one(an.dataset_kind(F.lit(x))) for x in ("Bacteria_x", "phage_only", "prophage_gc_control", "my_test", "val", "zzz")] == ["bacteria_only", "phage_only", "gc_control", "test_set", "dev_set", "unknown"]
    assert one(an.run_name(F.lit("a___b___ls1024___lr0.0004"))) == {"part0": "a", "part1": "b", "ls": "1024", "lr": "0.0004"}


def test_annotations(one):
    assert one(an.contains_any(F.lit("Putative Tail fibre"))) and not one(an.contains_any(F.lit(None).cast("string")))
    assert [one(an.category(F.lit(x))) for x in ("hypothetical phage protein", "tRNA ligase", "tail protein", "toxin HicA", "", "xyz")] == ["hypothetical protein", "tRNA related", "phage-related", "toxin-antitoxin", "unknown", "other"]
    assert one(an.cog_letters(F.lit("KL"))) == ["K", "L"] and one(an.cog_letters(F.lit(" "))) == ["-"]
    assert one(an.cog_label(F.lit(None).cast("string"), F.lit("Hypothetical protein"))) == "HYPOTHETICAL"


def test_numbers(one):
    assert one(an.as_number(F.lit(" "))) is None and one(an.as_number(F.lit("nan"))) is None and one(an.as_number(F.lit("1.5"))) == 1.5
    assert one(an.as_label(F.lit("1.0"))) == 1 and one(an.as_label(F.lit("x"))) is None
    assert one(an.half_even(F.lit(0.0625))) == pytest.approx(0.062)
    assert one(an.softmax_1(F.lit(0.0), F.lit(0.0))) == 0.5 and one(an.sigmoid(F.lit(0.0))) == 0.5
    assert tuple(one(an.peak({"A": "a", "B": "b"}), a=2, b=2)) == (2, "A")
    s = one(an.activation_summary(F.array(F.lit(0.0), F.lit(2.0))))
    assert (s["max"], s["mean"], s["share"]) == (2.0, 1.0, 0.5)
    v = F.array(F.array(F.lit(1.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(2.0)))
    assert one(an.pooled(v, "mean")) == [2, 3] and one(an.pooled(v, "max")) == [3, 4] and one(an.pooled(v, "mean", F.array(F.lit(1), F.lit(0)))) == [1, 4]
    assert one(an.cell(F.lit(1.5), 2)) == "1.50" and one(an.cell(F.lit(None).cast("double"))) == ""
    assert one(an.release_stamps(F.lit("2024-03-15").cast("date"), 1)) == ["1Mar2024", "1Feb2024"]
