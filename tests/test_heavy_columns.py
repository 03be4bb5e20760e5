"""What is done once, and what is not carried along."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_diarize_carries_no_vectors(spark, monkeypatch):
    from chalkline.queries import topics as T

    written = []
    real = T.materialise
    monkeypatch.setattr(T, "materialise", lambda df: written.append(df.columns) or real(df))
    assert T.diarize(spark, FOLDER).count() == T.L.segments(spark, FOLDER).count()
    assert written and not any("vector" in x or "text" in x for x in written)


def test_removed_segments_finds_interference_once(spark, monkeypatch):
    from chalkline.queries import editing as E

    found = []
    real = E.interference
    monkeypatch.setattr(E, "interference", lambda *a: found.append(a) or real(*a))
    assert E.removed_segments(spark, FOLDER).count()
    assert len(found) == 1
