"""Packing, mixing and severity, and their defined cases."""

import random
from collections import Counter

import numpy as np
import pytest

from windrow.llm import mixing, packing, severity as sv
from windrow.llm.tokens import count_tokens, encoder, parts

SCHEMA = "doc_id bigint, text string, source string, size int, rank int"


def test_parts_have_the_tokens_of_the_whole():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeé, .\n") for _ in range(rng.randrange(1, 12))) for _ in range(3000))
    assert "".join(parts(text, 500)) == text
    whole = len(encoder().encode_ordinary(text))
    assert sum(len(encoder().encode_ordinary(x)) for x in parts(text, 500)) == whole
    assert count_tokens(None) == count_tokens("") == 0
    assert count_tokens("ACGT" * 5000) > 3000


def test_nnls():
    rng = np.random.default_rng(2)
    a = rng.random((20, 60))
    truth = np.where(rng.random(60) < 0.2, rng.random(60), 0)
    x = packing.nnls(a, a @ truth)
    assert (x >= 0).all() and np.allclose(a @ x, a @ truth, atol=1e-6)
    y = packing.nnls(np.eye(3), np.array([1.0, -1.0, 2.0]))
    assert np.allclose(y, [1, 0, 2])
    assert packing.nnls(np.zeros((3, 0)), np.ones(3)).shape == (0,)


@pytest.mark.parametrize("capacity", [1, 7, 100, 3072])
def test_plans_place_every_text_once(capacity):
    rng = random.Random(3)
    histogram = Counter(min(capacity - 1, max(1, int(rng.expovariate(6 / capacity)))) for _ in range(4000)) if capacity > 1 else {}
    runs = packing.plan(dict(histogram), capacity)
    placed, load = {}, Counter()
    for n, first, count, container in runs:
        for k in range(count):
            assert (n, first + k) not in placed
            placed[n, first + k] = container + k
            load[container + k] += n
    assert len(placed) == sum(histogram.values())
    if placed:
        assert max(load.values()) <= capacity
        assert len(load) <= 1.03 * -(-sum(load.values()) // capacity) + 1


def test_pack_table(spark):
    words = " ".join(f"word{i}" for i in range(3000))
    texts = [words, None, "", "short text", "short text", "ACGT" * 6000, *("some text " * n for n in range(1, 120))]
    df = spark.createDataFrame([(i, t, "s", 1, 1) for i, t in enumerate(texts)], SCHEMA)
    rows = packing.pack(df).collect()
    load, of = Counter(), {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
        if r["container"] is None:
            assert r["token_to"] == 0
        else:
            load[r["container"]] += r["token_to"] - r["token_from"]
    assert max(load.values()) <= 3072 and set(of) == set(range(len(texts)))
    for i, parts_ in of.items():
        parts_.sort(key=lambda r: r["piece"])
        n = count_tokens(texts[i])
        assert parts_[0]["token_from"] == 0 and parts_[-1]["token_to"] == n and len(parts_) == parts_[0]["pieces"] == max(1, -(-n // 3072))
        assert all(a["token_to"] == b["token_from"] for a, b in zip(parts_, parts_[1:]))
    assert packing.packing_report(packing.pack(df)).first()["tokens"] == sum(map(count_tokens, texts))
    assert packing.pack(df.limit(0)).isEmpty()
    assert packing.packing_report(packing.pack(df.limit(0))).first()["containers"] == 0


def test_pivot_keeps_mass_and_probabilities():
    sizes = [5.0, 3.0, 8.0, 1.0, 2.0, 6.0]
    start = [0.3, 0.5, 0.7, 0.2, 0.9, 0.4]
    seen = np.zeros(6)
    for i in range(4000):
        out, open_at = mixing.pivot(start, sizes, random.Random(i))
        assert abs(np.dot(out, sizes) - np.dot(start, sizes)) < 1e-6
        assert all(v in (0.0, 1.0) for k, v in enumerate(out) if k != open_at)
        seen += out
    assert np.allclose(seen / 4000, start, atol=0.03)


@pytest.mark.parametrize("leaf", [mixing.LEAF, 8])
def test_mix(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", 4)
    rng = random.Random(4)
    rows = [(i, "tok " * rng.randrange(1, 60), " BIG " if i % 2 else "big", 1, 1) for i in range(600)] + [(1000 + i, "tok " * 20, "small", 1, 1) for i in range(20)] + [(2000, None, "big", 1, 1), (2001, "tok " * 50, None, 1, 1), (2002, "", "small", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("Big", 0.6, 2), ("small", 0.3, 3), ("absent", 0.1, 5)], "source string, weight double, max_repeats bigint")
    mix, report = mixing.mix_sources(df, targets)
    got = {r["source"]: r for r in report.collect()}
    assert {s for s, r in got.items() if r["short"]} == {"small", "absent"}
    assert abs(got["Big"]["mixed_tokens"] - got["Big"]["target_tokens"]) <= 120
    assert got["small"]["mixed_tokens"] == 3 * got["small"]["source_tokens"]
    copies = {r["doc_id"]: r["copies"] for r in mix.collect()}
    assert 2000 not in copies and 2001 not in copies and max(copies.values()) == 3
    none, empty = mixing.mix_sources(df.limit(0), targets)
    assert none.isEmpty() and empty.filter("short").count() == 0


BAD = [
    "You are a worthless idiot and should die.", "You are a w0rthle$$ 1d10t.", "Y​ou are a wor​thless idi​ot.", "You stuuuupid fooool.", "You are a s-t-u-p-i-d m.o.r.o.n.", "You utpid sutpid mroon, you idiot.",
    "Immigrants are vermin and should be kept out.", "She moaned as he kissed her naked breasts.", "I will find you and break your fingers.", "Du bist ein dummer Idiot.", "Eres un idiota inútil.", "Kill yourself, you lоser.",
]
GOOD = [
    "The suicide vector carries an integrase and cannot replicate.", "Kill the process before it chokes the node.", "The parasite kills its host cells.", "We need an idiot-proof protocol.", "Naked DNA was taken up by the recipients.",
    "The code of conduct forbids harassment and hate speech.", "I made a stupid mistake in the table.", "Breast tissue isolates of E. coli.", "Mean coverage of contig 7 dropped to 3.", "The sex pilus is encoded on the plasmid.",
]


def test_severity_of_plain_and_disguised_language(spark):
    rows = [(i, t, " A ", 1, 1) for i, t in enumerate([*BAD, *GOOD, None, "", "word " * 30_000 + BAD[0]])]
    scored = {r["doc_id"]: r for r in sv.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(len(BAD)):
        assert scored[i]["flagged"], (BAD[i], scored[i]["severity"])
    for i in range(len(BAD), len(BAD) + len(GOOD)):
        assert not scored[i]["flagged"], (rows[i][1], scored[i]["severity"])
    n = len(BAD) + len(GOOD)
    assert scored[n]["severity"] == scored[n + 1]["severity"] == 0 and scored[n + 2]["flagged"] and scored[0]["source"] == "a"
    rates = sv.severity_rates(sv.score_documents(spark.createDataFrame(rows, SCHEMA))).first()
    assert rates["texts"] == len(rows) and rates["flagged"] == len(BAD) + 1


@pytest.mark.parametrize("token, entries", [
    *((t, [e]) for t, e in zip("rat5 pig5 dog5 ape5 slu7 cun7 idio7 whor3 pu74 p357 b347 d13 g45".split(), "rats pigs dogs apes slut cunt idiot whore puta pest beat die gas".split(), strict=True)),
    ("stupid-idiot1", ["stupid", "idiot"]), ("you-idio7", ["you", "idiot"]), ("you_idio7", ["you", "idiot"]), ("such-a-very-long-token-with-stup1d-idio7", ["stupid", "idiot"]), ("you/id*ot", ["you", "idiot"]),
    ("phage7", ["phage"]), ("idi.0t", ["idiot"]), ("bra1n-d3ad", ["brain-dead"]), ("kpn1", []), ("node_455_length_900", ["node"]),
])
def test_signs_at_the_end_and_joined_words(token, entries):
    assert [e for _, e in sv.words(token) if e] == entries


#: Sentences of the same kinds that are neither seeds nor of the given texts.
UNSEEN = [
    "You are a whore.", "You are a whor3.", "You are an imbecile.", "You are an imbecil3.", "You m0therfucker_you_b4stard_idiot.", "All Muslims should be rounded up and shot.", "I'm going to slit your throat tonight.",
    "Deport every last one of those filthy migrants.", "Black people are stupid animals.", "Ich werde dich finden und umbringen.", "Te voy a partir la cara, imbécil.", "Je vais te casser la gueule.",
    "She spread her legs and he pushed his cock inside her.", "I want you to lick my pussy.", "Gays should burn in hell.", "What a dumb bitch she is.",
]


def test_unseen_sentences():
    w, reader = sv.untaught(), sv.Reader()
    score, _, _ = sv.worst_passages(reader, UNSEEN, w)
    missed = [x for x, s in zip(UNSEEN, sv.severity(score, w[-2:]), strict=True) if s < sv.FLAGGED]
    assert not missed


def test_passages_and_windows():
    reader = sv.Reader()
    text = "One here. Two there!\nStill two? “Quoted.” Last\n\nAfter a gap\nand on " + " ".join(f"w{i}" for i in range(200))
    pages = sv.Passages(reader, [text, "", "alone"])
    cut = [pages.text(k) for k in range(len(pages.owner))]
    assert cut[:5] == ["One here.", "Two there!", "Still two? “Quoted.”", "Last", "After a gap and on " + " ".join(f"w{i}" for i in range(43))] and cut[-1] == "alone"
    assert pages.owner.tolist() == [0] * (len(cut) - 1) + [2]
    long = cut[4:-1]
    assert all(len(x.split()) <= sv.WINDOW for x in long) and {w for x in long for w in x.split()} >= {f"w{i}" for i in range(200)}
    whole = sv.features(pages)
    apart = [f for t in (text, "alone") for f in sv.read(reader, t)]
    assert len(whole) == len(apart) and all(sorted(a) == sorted(b) for a, b in zip(whole, apart, strict=True))
    w = np.random.default_rng(1).normal(size=sv.SIZE + 2)
    assert np.allclose(sv.scores(pages, w), [w[f].sum() for f in whole], atol=1e-3)
    best, where, number = sv.worst_passages(reader, [text, "", None, "alone"], w)
    assert number.tolist() == [len(cut) - 1, 0, 0, 1] and where[1] is None and where[3] == "alone" and np.isclose(best[0], max(w[f].sum() for f in whole[:-1]), atol=1e-3)


def test_fit_learns_and_orders():
    reader = sv.Reader()
    texts = [(2.0, sv.read(reader, f"The run ended at {i}. Go and zorblat the grumpf, please.")) for i in range(40)] + [(0.0, sv.read(reader, f"Please count the reads of run {i}.")) for i in range(60)]
    w = sv.fit(texts)

    def found(model, text):
        return sv.severity(sv.worst_passages(reader, [text], model)[0], model[-2:])[0]

    other = "They zorblat the grumpf."
    assert found(sv.untaught(), other) < sv.FLAGGED <= found(w, other) and w[-1] > w[-2]
    assert found(w, "Please count the reads.") < sv.FLAGGED and (sv.fit([]) == sv.untaught()).all()
    p = sv.severity(np.array([-10.0, 0.0, 30.0]), w[-2:])
    assert (np.diff(p) > 0).all() and p[0] < 0.01 and p[2] > 1.99


def test_fit_ordinal_recovers_grades():
    rng = np.random.default_rng(5)
    rows, grades = [], []
    for _ in range(3000):
        r = sorted(rng.choice(6, size=rng.integers(0, 5), replace=False).tolist())
        z = sum((2.0, -2.0, 1.0, 0.0, 3.0, -1.0)[i] for i in r) + rng.logistic()
        rows.append(r)
        grades.append(0 if z < 0.5 else 1 if z < 1.5 else 2)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    w = sv.fit_ordinal(np.concatenate(rows).astype(int), ends, np.array(grades), np.ones(len(rows)), np.full(6, 0.01))
    assert np.allclose(w[:6], (2, -2, 1, 0, 3, -1), atol=0.4) and np.allclose(w[6:], (0.5, 1.5), atol=0.3)


def test_held_out_labels(spark, sf):
    """The fit on one half of the labels agrees with most labels of the other half."""
    d = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/doc_labels.parquet").filter("verdict IN ('ok', 'abuse', 'hate', 'sexual')")
    model = sv.train(docs, labels.filter("doc_id % 2 = 0"))
    other = labels.filter("doc_id % 2 = 1").select("doc_id", "verdict").distinct()
    got = sv.score_documents(docs, model=model).join(other, "doc_id").collect()
    right = sum(r["flagged"] == (r["verdict"] != "ok") for r in got)
    assert right >= 0.8 * len(got)


def test_empty_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, verdict string")
    assert sv.score_documents(empty, none).isEmpty() and sv.severity_rates(sv.score_documents(empty, none)).isEmpty()
