import itertools
import random

import pytest

from tideline.llm.mixing import DEFAULT_RANKS, PATTERN, Flow, Mixture, encoder, largest_total, n_tokens, route


def cheapest(arcs, n, source, sink):
    """Greatest flow at least cost by trying all integer flows on a tiny network."""
    best = (0, 0)
    for flow in itertools.product(*(range(c + 1) for _, _, c, _ in arcs)):
        balance = [0] * n
        for (a, b, _, _), x in zip(arcs, flow):
            balance[a] -= x
            balance[b] += x
        if all(balance[v] == 0 for v in range(n) if v not in (source, sink)):
            best = max(best, (balance[sink], -sum(x * c for (_, _, _, c), x in zip(arcs, flow))))
    return best[0], -best[1]


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_the_cheapest(seed):
    rng = random.Random(seed)
    arcs = [(a, b, rng.randrange(0, 3), rng.randrange(0, 4)) for a, b in [(0, 2), (0, 3), (2, 3), (2, 4), (3, 4), (4, 1), (3, 1)]]
    f = Flow()
    ids = [f.add(*a) for a in arcs]
    sent = f.run(0, 1)
    cost = sum(f.used(i) * a[3] for i, a in zip(ids, arcs))
    assert (sent, cost) == cheapest(arcs, 5, 0, 1)


def test_shared_texts_save_repetitions():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 20}
    sent, used = route(patterns, {"a": 100, "b": 70}, {"a": 3, "b": 3})
    assert sent == 170
    assert used == {(("a",), "a"): 100, (("a", "b"), "b"): 50, (("b",), "b"): 20}


def test_largest_total():
    assert largest_total({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.4, "gone": 0.1}, {"a": 1, "b": 2, "gone": 9}) in (50, 51, 52)
    assert largest_total({}, {"a": 1.0}, {"a": 1}) == 0


def mixture(spark, rows, targets, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    return Mixture(docs, spark.createDataFrame(targets, "source string, target_share double, max_repeats long"), **more)


def test_mixture(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"word{rng.randrange(999)}" for _ in range(rng.randrange(1, 40)))
    rows = [(i, text(), "abc"[i % 3], "z") for i in range(240)]
    rows += [(1000 + i, rows[i][1], "c", "z") for i in range(0, 60)]  # copies under another source
    rows += [(2000, None, "a", "z"), (2001, "", "a", "z"), (2002, "lost", None, "z"), (2003, "else", "other", "z"), (5, rows[5][1], "c", "z")]
    targets = [("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.2, 3), ("empty", 0.1, 4), (None, 0.1, 1)]
    m = mixture(spark, rows, targets)
    sizes = {r.doc_id: r.tokens for r in m.sized.collect()}
    enc = encoder(DEFAULT_RANKS, PATTERN)
    assert sizes[7] == len(enc[0].encode_ordinary(rows[7][1]))
    got = m.selected().collect()
    limit = {s: r for s, _, r in targets}
    assert all(1 <= r.uses <= limit[r.source] for r in got)
    assert len({(r.doc_id, r.source) for r in got}) == len(got)
    report = {r.source: r for r in m.shares_reached().collect()}
    largest = max(sizes.values())
    for s, share in (("a", 0.5), ("b", 0.2), ("c", 0.2)):
        assert abs(report[s].reached - share * m.total) <= 4 * largest  # whole texts at each end of each stretch
    assert report["empty"].reached == 0 and set(report) == {"a", "b", "c", "empty"}
    assert abs(sum(r.share for r in report.values()) - 1) < 1e-9
    again = mixture(spark, rows[::-1], targets).selected().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_fixed_total_and_empty(spark):
    rows = [(i, "one two three four", "a", "z") for i in range(10)]
    m = mixture(spark, rows, [("a", 1.0, 2)], total_tokens=6)
    assert m.selected().count() == 1  # all ten are one text
    assert mixture(spark, [], [("a", 1.0, 2)]).selected().count() == 0
    assert mixture(spark, rows, []).shares_reached().count() == 0


def test_long_blanks_are_counted_too():
    enc = encoder(DEFAULT_RANKS, PATTERN)
    count = lambda t: n_tokens(enc, t, PATTERN)
    for blank in (" ", "\n", " \n\t"):
        text = "word's 12 is" + blank * 1200 + "then, 3.5 ends" + blank * 1001
        assert count(text) == len(enc[0].encode_ordinary(text))
        assert count("x" + blank * 1_000_000 + "y") > 2
