"""Line dedup against a direct computation; runs, levels and batches."""

import hashlib
import inspect

import pytest

from callrisk.llm import line_dedup, queries

from .conftest import rows_of

BLANK = " \t\n\x0b\x0c\r"


def keys(text):
    up, low = line_dedup.UPPER, line_dedup.UPPER.lower()
    return [(x, x.strip(BLANK).translate(str.maketrans(up, low))) for x in (text or "").split("\n")]


def brute(rows):
    rank = lambda i: (i is None, i or 0)
    owner = {}
    for i, t in rows:
        for _, k in keys(t):
            if len(k) >= 10:
                owner[k] = min(owner.get(k, rank(i)), rank(i))
    out = []
    for i, t in rows:
        lines = keys(t)
        kept = [x for x, k in lines if len(k) < 10 or owner[k] == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_documents(documents, batches):
    got = queries.line_digest(line_dedup.dedup_lines(documents, batches=batches)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows_of(documents))


def test_edges(edge, empty, spark):
    got = queries.line_digest(line_dedup.dedup_lines(edge)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows_of(edge))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_blanks_case_length_and_repeats(spark):
    rows = [(3, "  Same Line Here \t\nsame line here\nshort"), (1, "SAME LINE HERE\r\nshort\n"), (2, "short\nsame line here"),
            (4, "Éééééééééé\nééééééééé"), (5, "Éééééééééé\néééééééééé"), (6, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df, batches=3).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == {
        1: (3, 0, "SAME LINE HERE\r\nshort\n"), 2: (2, 1, "short"), 3: (3, 2, "short"),
        4: (2, 0, "Éééééééééé\nééééééééé"), 5: (2, 1, "éééééééééé"), 6: (3, 0, "\n\n")}


def test_runs_are_compacted_and_disjoint(spark):
    runs = line_dedup.LineRuns(spark)
    for k in range(5):
        batch = spark.range(k * 10, k * 10 + 15).selectExpr("id AS h1", "id AS h2", "id AS owner", "1L AS n")
        runs.add(runs.write(runs.seen(batch)))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    seen = [r.h1 for name in runs.runs() for r in runs.hashes(name).collect()]
    assert sorted(seen) == list(range(55))
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_null_and_repeated_ids(spark):
    """Null ids are one document after all others; rows of equal id keep their common lines."""
    rows = [(None, "shared line one\nonly here, null"), (None, "shared line one\nonly here, null"),
            (None, "null rows share this\nx"), (None, "null rows share this\ny"), (4, "same id line\nshared line one"),
            (4, "same id line\nother text"), (9, "same id line\nother text\nsame id line\nlast"), (9, "last one of nine")]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(4)
    got = queries.line_digest(line_dedup.dedup_lines(df, batches=2)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows * 3)


def test_runs_lie_in_the_shared_folder_and_go(spark, documents, monkeypatch):
    import os

    from callrisk.llm import tasks

    folders = []
    monkeypatch.setattr(line_dedup, "shared_path", lambda s, n: folders.append(tasks.shared_path(s, n)) or folders[-1])
    assert line_dedup.dedup_lines(documents, batches=4).count() == documents.count()
    assert len(folders) == 4 and all(f.startswith(spark.sparkContext.getCheckpointDir()) for f in folders)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in folders)
    with pytest.raises(ValueError):
        tasks.discard(spark, "/elsewhere/run")


def test_main_path_is_native():
    source = inspect.getsource(line_dedup)
    assert not any(w in source for w in ("udf", "InPandas", "InArrow", ".rdd", "numpy", "pandas"))


def test_named_columns_are_carried(edge):
    got = line_dedup.dedup_lines(edge, keep=("label", "n_tokens"))
    assert got.columns[-2:] == ["label", "n_tokens"] and got.count() == edge.count()
