"""Personal data in wordings of no test table; every check digit decides; names outside the lexicon."""

import random

import pytest

from tessera.llm import bpe, pii

LEXICON = [("Hana", "given"), ("Will", "given"), ("Rosa", "given"), ("Velmork", "family"), ("Power", "family")]


@pytest.fixture(scope="module")
def names():
    return pii.NameFinder(LEXICON, bpe.read_ranks(bpe.vocabulary_bytes()))


def spans(text, names, kind=None):
    return [text[s.start : s.end] for s in pii.find_spans(text, names) if kind in (None, s.kind)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Written by Maria Schneider and John Smith.", ["Maria Schneider", "John Smith"]),
        ("Dr. Anna Kowalska graded it.", ["Anna Kowalska"]),
        ("Prof. G. H. Hardy and J. E. Littlewood wrote it.", ["G. H. Hardy", "J. E. Littlewood"]),
        ("Name: Müller, Hans-Peter", ["Müller, Hans-Peter"]),
        ("Herr Klaus Zimmermann wohnt hier.", ["Klaus Zimmermann"]),
        ("Автор: Иван Петров", ["Иван Петров"]),
        ("Autor: José García López", ["José García López"]),
        ("Thanks to Petra van den Berg for the idea.", ["Petra van den Berg"]),
        ("Best regards,\nTom O'Brien", ["Tom O'Brien"]),
        ("JOHN SMITH\n12 Elm Street", ["JOHN SMITH"]),
        ("marked by ELENA ROSSI", ["ELENA ROSSI"]),
        ("hana velmork came, then VELMORK, HANA and Hana Q. Nowakowska", ["hana velmork", "VELMORK, HANA", "Hana Q. Nowakowska"]),
        ("Solved by Long Division and by Mathematical Induction.", []),
        ("The proof is by Cauchy Schwarz; see the Riemann Hypothesis.", []),
        ("Gauss's lemma by Carl Friedrich Gauss's theorem", []),
        ("The Velmork lemma. Will Power series converge? Hana went home to New York.", []),
        ("from New York to San Francisco by Problem Five", []),
        ("Mail hana.velmork@x.test", []),
    ],
)
def test_names_in_plain_words(names, text, want):
    assert spans(text, names, "name") == want


def valid(kind: str, rng: random.Random) -> str:
    """A number whose check digit holds, by search."""
    while True:
        if kind == "mod97_key":
            body = "".join(rng.choice("0123456789") for _ in range(13))
            body = rng.choice("12") + body[1:]
            n = f"{body}{97 - int(body) % 97:02d}"
        elif kind == "letter_23":
            n = "".join(rng.choice("0123456789") for _ in range(8)) + rng.choice("ABCDEFGHJKLMNPQRSTVWXYZ")
        elif kind == "mod11_10":
            n = "".join(rng.choice("123456789") for _ in range(11))
        else:
            n = "".join(rng.choice("123456789") for _ in range(9))
        if getattr(pii, kind)(n):
            return n


SHOWN = {
    "mod97_key": lambda n: f"{n[0]} {n[1:3]} {n[3:5]} {n[5:7]} {n[7:10]} {n[10:13]} {n[13:]}",
    "letter_23": lambda n: f"{n[:8]}-{n[8]}",
    "mod11_10": lambda n: f"{n[:2]} {n[2:5]} {n[5:8]} {n[8:]}",
    "luhn": lambda n: f"{n[:3]} {n[3:6]} {n[6:]}",
}
LEADS = ("The applicant gave the ID ", "Insured resident, id: ", "Ciudadana titular, identidad ")


@pytest.mark.parametrize("check", SHOWN)
def test_every_check_digit_decides(names, check, monkeypatch):
    rng = random.Random(check)
    good = [rng.choice(LEADS) + SHOWN[check](valid(check, rng)) for _ in range(30)]
    bad = []
    while len(bad) < 30:
        n = valid(check, rng)
        n = n[:4] + str((int(n[4]) + rng.randrange(1, 9)) % 10) + n[5:]
        if not getattr(pii, check)(n):
            bad.append("Id " + SHOWN[check](n))
    found = [bool(spans(t, names, "id_number")) for t in good]
    assert all(found) and not any(spans(t, names, "id_number") for t in bad)
    monkeypatch.setattr(pii, check, lambda n: False)
    assert sum(bool(spans(t.replace("applicant", "form").replace("resident", "").replace("Insured", "").replace("titular", "").replace("Ciudadana", ""), names, "id_number")) for t in good) == 0
    monkeypatch.setattr(pii, check, lambda n: True)
    assert any(spans(t, names, "id_number") for t in bad)


def test_context_words_decide(names):
    assert spans("Reach the desk by phone, 512-4877", names, "phone") and not spans("the interval 512-4877", names, "phone")
    assert spans("Insured resident: 046 454 286", names) == ["046 454 286"] and not spans("compute 046 454 286", names)


def test_odd_texts(names):
    assert pii.find_spans("", names) == [] and pii.find_spans("\n" * 1000 + "a" * 100_000, names) == []
    long = "Hana walked on. " * 20_000 + "Hana Velmork"
    assert spans(long, names) == ["Hana Velmork"]
    assert spans("Name: " * 5_000, names) == []
    empty = pii.NameFinder([])
    assert spans("Written by Maria Schneider.", empty) == ["Maria Schneider"]
    found = pii.find_spans("Hana Velmork, a@b.test", names)
    assert pii.redact("Hana Velmork, a@b.test", found) == "[NAME], [EMAIL]"


GIVEN = "Maria John Anna Peter Chloe Lars Ingeborg Pablo Fatima Dmitri Aleksandra Kwame Siobhan Hiroshi Zofia Matteo Greta Tomasz Leila Björn".split()
FAMILY = "Schneider Smith Kowalska Okafor Lindqvist Hernandez Dubois Rossi Yamamoto Petrov Novak Fitzgerald Haddad Jansen Moreau Papadopoulos Berger Costa Nilsen O'Brien".split()
AROUND = ("Written by {}.", "Dr. {} agreed with this.", "Name: {}", "Best regards,\n{}", "Many thanks to {} for the hint.", "{}\nanyone@host.example", "Author: {} (2019)", "Asked by {}, answered later", "Herr {} fragte nach.", "Auteur : {}", "Contact {} at +44 20 7946 0123")
OTHER = ("Proof by Mathematical Induction", "from New York to Los Angeles", "see the Pythagorean Theorem", "Solved by Long Division", "The Mean Value Theorem by Contradiction", "Dear Students", "Contact Support", "Author: Unknown Source", "by Green Line and Red Line", "Name: First Prize", "Final Answer Below", "Die Grüne Aufgabe von Heute", "Thanks to Everyone Here", "Step Two by Step Three")


def test_recall_on_names_outside_the_lexicon(names):
    rng = random.Random(8)
    hit = total = 0
    lost = []
    for k in range(440):
        given, family = rng.choice(GIVEN), rng.choice(FAMILY)
        name = rng.choice((f"{given} {family}", f"{given} {rng.choice('ABCEHKLMT')}. {family}", f"{given[0]}. {family}", f"{given} {family}".upper(), f"{given} {family}-{rng.choice(FAMILY[:8])}"))
        text = AROUND[k % len(AROUND)].format(name)
        total += 1
        good = name in spans(text, names, "name")
        hit += good
        if not good:
            lost.append(text)
    print(f"{hit} of {total}", lost[:12])
    assert hit >= 0.9 * total
    assert not [t for t in OTHER if spans(t, names, "name")]
