"""Copies of a text within a source are documents of their own."""

from collections import Counter

from tideline.llm.mixing import Mixture, route


def mixture(spark, rows, targets, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return Mixture(docs, spark.createDataFrame(targets, "source string, target_share double, max_repeats long"), **more)


def test_copies_add_to_what_a_source_has(spark):
    rows = [(i, "one and the same text", "a") for i in range(40)] + [(100 + i, f"text {i} of the source", "a") for i in range(20)] + [(200 + i, f"text {i} elsewhere", "b") for i in range(400)]
    rows += rows[:5]  # repeated rows are no further documents
    m = mixture(spark, rows, [("a", 0.5, 2), ("b", 0.5, 1)])
    sizes = {r.doc_id: r.tokens for r in m.sized.collect()}
    has = sum(n for d, n in sizes.items() if d < 200)
    report = {r.source: r for r in m.shares_reached().collect()}
    assert report["a"].available == has
    assert abs(m.total - 4 * has) <= 4  # a is what binds: all its documents, twice
    got = m.selected().collect()
    assert Counter(r.source for r in got)["a"] == len({r.doc_id for r in got if r.doc_id < 200}) >= 59
    assert all(r.tokens == sizes[r.doc_id] and 1 <= r.uses <= (2 if r.source == "a" else 1) for r in got)
    assert abs(report["a"].reached - m.total // 2) <= 2 * max(sizes.values())
    assert sorted(map(tuple, mixture(spark, rows[::-1], [("a", 0.5, 2), ("b", 0.5, 1)]).selected().collect())) == sorted(map(tuple, got))


def test_each_source_has_its_own_copies(spark):
    rows = [(i, "a text of both", "a") for i in range(6)] + [(10, "a text of both", "b")]
    m = mixture(spark, rows, [("a", 0.5, 1), ("b", 0.5, 3)], total_tokens=1000)
    got = {(r.doc_id, r.source): r.uses for r in m.selected().collect()}
    assert got == {**{(i, "a"): 1 for i in range(6)}, (10, "b"): 3}


def test_route_keeps_to_the_documents_of_each_source():
    both = ("a", "b")
    assert route({both: 60}, {"a": 100, "b": 100}, {"a": 1, "b": 2}, {(both, "a"): 60, (both, "b"): 10}) == (80, {(both, "a"): 60, (both, "b"): 20})
