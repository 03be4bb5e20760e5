"""Leaks of repeated rows."""

from chalkline.llm import leaks

WORDS = [f"word{i}" for i in range(40)]
TEXT = " ".join(WORDS)


def test_leaks_of_repeated_rows(spark):
    docs = [(1, "a b " + TEXT)] * 2 + [(2, "x " + TEXT), (2, "something else"), (3, " ".join(WORDS[:8])), (3, "y " * 7 + " ".join(WORDS[8:16])), (4, TEXT)]
    items = [(7, True, TEXT), (7, True, " ".join(WORDS[5:30])), (7, True, "other words of this item that are in no document at all here so"), (8, True, " ".join(WORDS[:12]))] * 2
    d = spark.createDataFrame(docs, "doc long, text string")
    q = spark.createDataFrame(items, "item long, words boolean, text string")
    for size in (1 << 20, 100):
        got = {(r.doc, r.item): r.n_units for r in leaks.find_leaks(d, "doc", "text", q, "item", "text", "words", range_bytes=size, halo_bytes=200).collect()}
        assert got == {(k, i): n for k in (1, 2, 4) for i, n in ((7, 29 + 14), (8, 1))}
