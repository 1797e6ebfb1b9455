"""A limit shows although a few texts are longer, and copies of a text are no limit."""

from tideline.llm.truncation import Truncation

KEYWORDS = "\nKeywords: mesh"


def body(k, n, tail):
    head = f"Number {k} ends. "
    return head + ("It goes on. " * (n // 10 + 1))[: n - len(head) - len(tail)] + tail


def truncated(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source")
    return {r.doc_id for r in Truncation(df).flags("doc_id").where("truncated").collect()}


def test_limits_below_the_greatest_length(spark):
    spread = [body(k, 300 + 37 * k, "") + "." for k in range(40)]  # up to 1 744
    at = [body(100 + k, 900, KEYWORDS) for k in range(6)] + [body(200 + k, 1500, KEYWORDS) for k in range(6)]
    near = [body(300 + k, 2990 - 7 * k, "the field dec…") for k in range(9)]
    longer = [body(400 + k, 4000 + 900 * k, "") + "." for k in range(3)] + [body(500, 3500, KEYWORDS), body(501, 3700, "the field dec…")]
    texts = spread + at + near + longer
    assert truncated(spark, texts) == set(range(len(spread), len(spread) + len(at) + len(near)))


def test_copies_are_no_limit(spark):
    texts = [body(k, 300 + 37 * k, "") + "." for k in range(40)] + [body(100, 900, KEYWORDS)] * 12
    assert truncated(spark, texts) == set()


def test_reasons_and_blocks_of_any_size(spark):
    """A source that stores 700 bytes at a time, one with a limit, one cut in transfer: each flag says what found it."""
    whole = [("blocks", "It ends." + " It goes on." * k) for k in range(40)] + [("limit", "So it is." * (k % 30 + 1)) for k in range(60)] + [("transfer", "It is so." * (k % 9 + 1)) for k in range(20)]
    cut = [("blocks", f"w{i} " * 3 + "x" * (700 * k - len(f"w{i} " * 3))) for i, k in enumerate((1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3))]
    cut += [("limit", f"v{i} " + "y" * (900 - len(f"v{i} "))) for i in range(9)] + [("transfer", "It breaks off here \\textbf{in the mid")]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(whole + cut)], "doc_id int, source string, text string")
    flags = {r.doc_id: r.reason for r in Truncation(df).flags("doc_id").collect()}
    assert all(flags[i] is None for i in range(len(whole)))
    got = [flags[i] for i in range(len(whole), len(whole) + len(cut))]
    assert got == ["limit"] * 20 + ["structure"]
    rates = {(r.source, r.reason): r.n_truncated for r in Truncation(df).rates().collect()}
    assert rates["blocks", "limit"] == 11 and rates["transfer", "structure"] == rates["transfer", "any"] == 1 and rates["limit", "near_limit"] == 0
    sizes = {r.src: r.block for r in Truncation(df).spikes().collect()}
    assert sizes["blocks"] in (700, 1400, 350, 175) and sizes["transfer"] is None
