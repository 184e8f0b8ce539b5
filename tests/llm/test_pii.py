"""The model of personal information: segments, exact readings, and texts of another origin."""

import json
import math
import random
from itertools import combinations
from pathlib import Path

import pytest

from corpusmix.llm import pii, pii_train

WEIGHTS = json.loads(pii.WEIGHTS.read_text())
LEXICON = pii.Lexicon([("given", "Amelie"), ("given", None), ("family", " ")])
MODEL = pii.Model(WEIGHTS, LEXICON)
EVERY = pii.Model(None, LEXICON)


def found(text: str) -> list[tuple[str, str]]:
    return [(s.kind, text[s.start : s.end]) for s in MODEL.read(text)]


def proposed(text: str, kind: str) -> set[str]:
    return {text[s.start : s.end] for s in EVERY.segments(text) if s.kind == kind}


def test_texts_of_another_origin():
    """Sentences written by hand about known people and places, apart from the templates that weights are fitted on."""
    lines = Path(__file__).with_name("pii_heldout.txt").read_text().splitlines()
    a = pii_train.accuracy(WEIGHTS, [(*pii_train.marked(x), LEXICON) for x in lines])
    assert all(p >= 0.9 for p, _, _ in a.values()), a
    assert all(r >= (0.85 if k == "name" else 0.9) for k, (_, r, _) in a.items()), a


@pytest.mark.parametrize("family", ["Smith", "Johnson", "Müller", "García", "Nguyen", "Okafor", "Kowalski", "Patel", "O'Brien", "McDonald"])
def test_names_that_no_list_has(family):
    assert found(f"We met Amelie {family} in town.") == [("name", f"Amelie {family}")]


@pytest.mark.parametrize("text", ["Emma Watson", "Robert Taylor", "Анна Петрова"])
def test_names_without_a_list(text):
    assert found(text) == [("name", text)]


def test_chinese_name():
    assert found("我叫王小明，今年三十岁。") == [("name", "王小明")]


@pytest.mark.parametrize("text", ["1600 Pennsylvania Avenue NW", "Via Roma 12", "Unter den Linden 77", "12 Broadway"])
def test_addresses(text):
    assert found(text) == [("address", text)]


def test_numbers():
    assert found("passport no. 123456789") == [("id", "123456789")]
    assert found("IBAN DE89 3704 0044 0532 0130 00") == []
    assert found("loss 3.14159265358 and 0.123456789, 12,345,678.9") == []


@pytest.mark.parametrize("local, domain", [("john.o'neil", "example.org"), ("x" * 76, "example.org"), ("anna.lindqvist", ".".join(c * 60 for c in "abc") + ".example.org")])
def test_whole_emails(local, domain):
    assert found(f"mail {local}@{domain} now") == [("email", f"{local}@{domain}")]


@pytest.mark.parametrize("text, kind, value", [
    ("tel 030 23125668 12 times", "phone", "030 23125668"), ("Tel. +49 171 2345678 2024 5678 9012 3456", "phone", "+49 171 2345678"), ("call +49.3012345678", "phone", "+49.3012345678"), ("555.123 4567", "phone", "555.123 4567"),
    ("an AB 12 34 56 C b", "id", "AB 12 34 56 C"), ("an 12345678Z", "id", "12345678Z"), ("Am Xgraben 12, Flat 3", "address", "Am Xgraben 12, Flat 3"), ("Am Xgraben 12, Flat 3", "address", "Am Xgraben 12"), ("Am Xgraben 12", "address", "Xgraben 12"),
    ("X" + "a" * 90 + "straße 103 b", "address", "X" + "a" * 90 + "straße 103 b"), ("Dr. Anna de la Cruz Soto spoke", "name", "Anna de la Cruz Soto"), ("Dr. Anna de la Cruz Soto spoke", "name", "Anna de la Cruz"), ("Cruz, Anna B.", "name", "Cruz, Anna"), ("ann dot lee at x dot org", "email", "ann dot lee at x dot org"), ("ann dot lee at x dot org", "email", "lee at x dot org"),
])
def test_every_border_is_proposed(text, kind, value):
    assert value in proposed(text, kind)


def chains(text, segs):
    """All readings: stretches of segments without overlap."""
    for k in range(len(segs) + 1):
        for c in combinations(sorted(segs, key=lambda s: s.start), k):
            if all(a.end <= b.start for a, b in zip(c, c[1:])):
                yield c


def near(text, a, b):
    return not any(c.isalnum() for c in text[a.end : b.start])


def worth(model, text, chain):
    return sum(s.score for s in chain) + sum(model.steps.get(model.step(text, a, b), 0.0) for a, b in zip(chain, chain[1:]) if near(text, a, b))


@pytest.mark.parametrize("seed", range(30))
def test_reading_is_the_best_of_all(seed, monkeypatch):
    r = random.Random(seed)
    text = "".join(r.choice("ab ,\n") for _ in range(24))
    segs = []
    for _ in range(9):
        s = r.randrange(20)
        segs.append(pii.Segment(s, s + r.randrange(1, 5), r.choice(pii.KINDS), r.uniform(-2, 3)))
    model = pii.Model({f"t:{a}>{b}:{g}": r.uniform(-2, 2) for a in pii.KINDS for b in pii.KINDS for g in "n,o_"}, LEXICON)
    monkeypatch.setattr(model, "segments", lambda t: list(segs))
    assert worth(model, text, model.read(text)) == pytest.approx(max(worth(model, text, c) for c in chains(text, segs)))


@pytest.mark.parametrize("seed", range(10))
def test_probabilities_add_up(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab ,") for _ in range(16))
    segs = sorted((pii.Segment(s, s + r.randrange(1, 4), "id", r.uniform(-2, 2)) for s in (r.randrange(12) for _ in range(6))), key=lambda s: (s.end, s.start))
    factor = {(i, j): r.uniform(-1, 1) for i in range(6) for j in range(6)}
    p, both, z = pii_train.readings(text, segs, [s.score for s in segs], lambda i, j: factor[i, j])
    at = {id(s): i for i, s in enumerate(segs)}
    every = list(chains(text, segs))
    w = [math.exp(sum(s.score for s in c) + sum(factor[at[id(a)], at[id(b)]] for a, b in zip(c, c[1:]) if near(text, a, b))) for c in every]
    assert z == pytest.approx(math.log(sum(w)))
    for i, s in enumerate(segs):
        assert p[i] == pytest.approx(sum(x for x, c in zip(w, every) if any(t is s for t in c)) / sum(w))


def test_left_out_segments_could_not_win():
    """Reading with and without leaving out segments beforehand gives the same."""
    whole = pii.Model(WEIGHTS, LEXICON)
    whole.least = {k: -1e9 for k in pii.KINDS}
    sums = lambda f: whole.sum(f()) if f else 0.0
    whole.add = lambda view, out, start, end, kind, own, features, left, right, rest=None, way="": out.append(pii.Segment(start, end, kind, own + sums(left) + sums(right) + sums(rest)))
    for line in Path(__file__).with_name("pii_heldout.txt").read_text().splitlines():
        text = pii_train.marked(line)[0]
        assert [(s.start, s.end, s.kind) for s in whole.read(text)] == [(s.start, s.end, s.kind) for s in MODEL.read(text)]


def test_too_many_names(spark, monkeypatch):
    monkeypatch.setattr(pii, "LEXICON", 1)
    names = spark.createDataFrame([("given", "A"), ("given", "B")], "name_type string, name string")
    with pytest.raises(ValueError):
        pii.find(spark.createDataFrame([(1, "x")], "doc_id long, text string"), names)
