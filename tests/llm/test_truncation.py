import pytest

from tideline.llm.truncation import CUT, MARKED, UNSURE, WHOLE, Truncation, ending

BODY = "\\begin{document}\nThe mesh converges quickly.\n"


@pytest.mark.parametrize(
    "tail,want",
    [
        ("It ends.", WHOLE), ("It ends.\n\n", WHOLE), ("It ends.\n\\end{document}\n", WHOLE), ("It ends.\n\\end{document}\n% end of file\n", WHOLE),
        ("As \\emph{we saw it end.}", WHOLE), ("(see~\\ref{sec:4}).", WHOLE), ("With $x < 1$.", WHOLE), ("Then\n\\[ x = 1 \\]", WHOLE), ("\\begin{align}\nx\n\\end{align}\n\n", WHOLE),
        ("It ends.\n\\bibliography{refs}", WHOLE), ("It ends.\n\n\\printbibliography", WHOLE), ("It ends.\n\\endinput", WHOLE), ("It ends.\n\n\\hfill$\\square$", WHOLE), ("It ends.\n\\input{appendix}\n", WHOLE),
        ("% Old text that\n% was dropped.", WHOLE), ("It ends.\n% TODO redo figure.", WHOLE), ("It ends. % a note", WHOLE), ("It en % a note", CUT), ("It ends.\n\n% converted by hand", UNSURE),
        ("The field decays \\ldots", UNSURE), ("It ends.\n\nKeywords: mesh, field", UNSURE), ("It ends.\n\\section{Results}\n", UNSURE),
        ("The field dec", CUT), ("The field decays", CUT), ("The field,", CUT), ("The field decays by \\emph{much", CUT), ("Then\n\\[ x =", CUT), ("With $x <", CUT), ("It ends.\n\\bibliogr", CUT), ("It ends.\n\\begin{ite", CUT),
        ("\\begin{itemize}\n\\item One ends.", CUT), ("\\begin{thebibliography}{9}", CUT), ("% Old text that\n% was dro", CUT), ("decays \ufffd", CUT),
        ("The field decays […]", MARKED), ("The field…", MARKED), ("The field...", MARKED), ("The field [...]", MARKED),
        ("", WHOLE),
    ],
)
def test_endings(tail, want):
    assert ending(BODY + tail if tail else tail) == want
    assert ending(None) == WHOLE


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, "x") for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, ending string")


def test_limits_decide_what_is_unsure(spark):
    whole = [("chars", f"Number {i} ends. " + "It goes on. " * (i % 7)) for i in range(40)]
    cut = lambda tail, n=150: ("It goes on. " * 40)[: n - len(tail)] + tail
    rows = whole + [("chars", cut(t)) for t in (" \nKeywords: mesh", " \nKeywords: fields", " it ends.", "word", "word")]
    rows += [("free", " It ends.\nKeywords: mesh"), ("free", None), ("free", ""), (None, "The wor")]
    got = {r.doc_id: r.truncated for r in Truncation(frame(spark, rows)).flags("doc_id").collect()}
    assert [i for i in sorted(got) if got[i]] == [40, 41, 43, 44, 48]
    assert 46 not in got


def test_bytes_blocks_and_marks(spark):
    pad = lambda n, tail: "é" * ((n - len(tail.encode())) // 2) + tail
    rows = [("bytes", pad(301, " é\nKeywords: ab")) for _ in range(3)] + [("bytes", f"Number {i} ends.") for i in range(30)]
    rows += [("blocks", "a. " * 100 + "x" * (512 * k - 300 - 18) + ".\nKeywords: meshes") for k in (1, 2, 2, 3)] + [("blocks", "It ends." + " It goes on." * k) for k in range(12)]
    rows += [("mark", "The field is wide. " * 20 + "It dec" + "a" * k + "…") for k in (1, 2, 3, 4)] + [("mark", "It ends…"), ("mark", "It ends.")]
    got = {}
    for r in Truncation(frame(spark, rows)).flags("doc_id").collect():
        got.setdefault(r.src, []).append(r.truncated)
    assert sum(got["blocks"]) == 4 and sum(got["mark"]) == 4


def test_rates_and_columns(spark):
    df = frame(spark, [("a", "It ends."), ("a", "It do"), (None, "x")])
    rates = {(r.source, r.column): (r.n, r.n_truncated) for r in Truncation(df, columns=["text", "ending"]).rates().where("reason = 'any'").collect()}
    assert rates[("a", "text")] == (2, 1) and rates[(None, "ending")] == (1, 1)
    assert Truncation(df.limit(0)).rates().count() == 0


@pytest.mark.parametrize("unit", ["{", "\\", "\\cite[", "- ", ".", "\\begin{a}", "% x\n", "\\'e", " ", "…", "\\qed "])
def test_very_long_texts_take_no_longer_than_their_length(unit):
    from time import process_time

    from tideline.llm.words import words

    began = process_time()
    ending("x" + unit * 200_000 + "y")
    words("x" + unit * 200_000 + "y")
    assert process_time() - began < 10
