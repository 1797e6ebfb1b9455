import random

import pytest

from tideline.llm.contamination import Contamination
from tideline.llm.words import words, words_at

RUN = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()


@pytest.mark.parametrize(
    "text,want",
    [
        ('Aufl\\"{o}sung gro\\ss e Stra{\\ss}e {\\"o}l', "auflosung grosse strasse ol"),
        ('\\"uber \\emph{\\"Uber} na\\"{\\i}ve fa\\c{c}ade \\v{s}a', "uber uber naive facade sa"),
        ("Über ﬁne Straße œuvre", "uber fine strasse oeuvre"),
        ("co-\noperate ex\\-ample soft\u00adware hy-phen", "cooperate example software hy phen"),
        ("% com-\n% mented\n% out", "commented out"),
        ("a~b\\,c \\textbf{d}e \\section*{f} \\cite[p.~3]{k1,k2} g\\citep{z} \\label{x:y} \\ref{q} \\eqref{w}", "a b c d e f g w"),
        ("x_1 + y^{2} \\alpha \\\\ 3.5", "x 1 y 2 3 5"),
        ("", ""),
    ],
)
def test_words(text, want):
    assert words(text) == want.split()
    found, at = words_at(text)
    assert found == want.split()
    assert all(0 <= a < b <= len(text) for a, b in at)


def test_words_of_null():
    assert words(None) == [] and words_at(None) == ([], [])


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")


def items(spark, *texts):
    return spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "item_id long, passage string")


def cases(spark):
    whole, short = " ".join(RUN), " ".join(RUN[:12])
    d = docs(spark, f"x {whole} y", f"x {short} z nu", whole.upper().replace(" ", "\n% "), None, "", f"{' '.join(RUN[:6])}\\cite{{q}} {{\\bf {' '.join(RUN[6:])}}}", whole + " " + whole, "w " * 50_000 + whole)
    return d, items(spark, f"start {whole} end", f"{whole}", "too short", None, "")


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_both_ways_agree(spark, bound):
    d, i = cases(spark)
    got = Contamination(i, broadcast_grams=bound).matches(d)
    hit = {0, 2, 6, 7}  # document 5 has the word bf between
    # {\bf is a command name: it is no word
    assert sorted(map(tuple, got.collect())) == sorted((x, y) for x in hit | {5} for y in (100, 101))


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages, bodies = [text(12) for _ in range(5)], [text(rng.randrange(0, 60)) for _ in range(60)]
    grams = lambda t: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)}
    want = sorted((d, 100 + i) for d, b in enumerate(bodies) for i, p in enumerate(passages) if grams(b) & grams(p))
    assert sorted(map(tuple, Contamination(items(spark, *passages), n=4).matches(docs(spark, *bodies)).collect())) == want


def test_spans_and_cleaning(spark):
    d, i = cases(spark)
    c = Contamination(i)
    spans = {}
    for r in c.spans(d).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.n_words))
    whole = len(" ".join(RUN))
    assert spans[0] == [(2, 2 + whole, 13)]
    assert spans[6] == [(0, 2 * whole + 1, 26)]
    out = {r.doc_id: (r.text, r.n_removed) for r in c.cleaned(d).collect()}
    assert out[0] == ("x   y", 1) and out[3] == (None, 0) and out[4] == ("", 0) and out[6] == (" ", 1)
    assert c.matches(c.cleaned(d)).count() == 0


def test_empty(spark):
    d, i = cases(spark)
    assert Contamination(i.limit(0)).matches(d).count() == 0
    assert Contamination(i).matches(d.limit(0)).count() == 0
