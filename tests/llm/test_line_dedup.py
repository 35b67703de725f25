import random

import pyarrow as pa

from textloom.llm import line_dedup as ld
from textloom.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, th string, mask int, first string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "a", 1, None) for i, t in rows], SCHEMA)
    out = line_dedup(df, **more)
    assert out.columns[:5] == df.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_shared_line_goes_from_all_documents(spark):
    rows = [(i, f"own line number {i}\nA  Shared line HERE\nend of {i} text") for i in (9, 3, 7)]
    assert run(spark, rows, threshold=2) == [(i, f"own line number {i}\nend of {i} text") for i in (3, 7, 9)]


def test_shared_line_stays_in_the_lowest_id_if_told(spark):
    rows = [(i, f"own line number {i}\nA  Shared line HERE\nend of {i} text") for i in (9, 3, 7)]
    got = run(spark, rows, threshold=2, keep_first=True)
    assert got == [(3, "own line number 3\nA  Shared line HERE\nend of 3 text"), (7, "own line number 7\nend of 7 text"), (9, "own line number 9\nend of 9 text")]


def test_at_the_threshold_nothing_goes(spark):
    rows = [(i, "the same old line") for i in range(3)]
    assert run(spark, rows, threshold=3) == sorted(rows)
    assert run(spark, rows, threshold=2) == [(0, ""), (1, ""), (2, "")]
    assert run(spark, rows, threshold=2, keep_first=True) == [(0, "the same old line"), (1, ""), (2, "")]


def test_repeats_within_a_document_count_once(spark):
    rows = [(1, "x y z\nx y z\nx y z"), (2, "x y z")]
    assert run(spark, rows, threshold=2) == rows


def test_short_lines_and_scripts_without_blanks_count_and_blank_lines_stay(spark):
    rows = [(i, f"Subscribe now\n\n  \n{i}\n版权所有，未经许可不得转载\nสงวนลิขสิทธิ์\nx") for i in range(5)]
    assert run(spark, rows, threshold=2) == [(i, f"\n  \n{i}") for i in range(5)]


def test_nulls_empty_repeated_and_no_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "a b c")]
    # ids None (one document), 3 and 4 hold it: three documents, and 3 is the lowest
    assert run(spark, rows, threshold=3) == sorted(rows, key=repr)
    assert run(spark, rows, threshold=2) == sorted([(None, ""), (None, ""), (1, None), (2, ""), (3, ""), (3, ""), (4, "")], key=repr)
    assert run(spark, rows, threshold=2, keep_first=True) == sorted([(None, ""), (None, ""), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "")], key=repr)
    assert run(spark, [], threshold=2) == []


def test_drop_emptied_and_counts(spark):
    df = spark.createDataFrame([(i, "same long line\nsame long line too") for i in range(4)] + [(9, ""), (10, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in line_dedup(df, threshold=2, drop_emptied=True).collect()) == [9, 10]
    assert sorted(r["doc_id"] for r in line_dedup(df, threshold=2, drop_emptied=True, keep_first=True).collect()) == [0, 9, 10]
    counts = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup(df, threshold=2, counts=True).collect()}
    assert counts == {**{i: (2, 2) for i in range(4)}, 9: (1, 0), 10: (0, 0)}


def test_very_long_text(spark):
    text = "\n".join(f"line number {i}" for i in range(50_000))
    assert run(spark, [(i, text) for i in range(3)], threshold=2) == [(i, "") for i in range(3)]


def test_documents_without_an_id_are_counted_by_their_texts(spark):
    rows = [(None, f"own line number {i}\na shared line here") for i in range(4)]
    got = run(spark, rows + rows[:1], threshold=3, keep_first=True)
    assert sum("shared" in t for _, t in got) in (1, 2) and len({t for _, t in got if "shared" in t}) == 1
    assert not any("shared" in t for _, t in run(spark, rows + rows[:1], threshold=3))
    assert run(spark, rows, threshold=4) == sorted(rows, key=repr)


def test_hashes_are_equal_where_normal_forms_are():
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "a\n", "\n a"] + ["".join(rng.choice("aA b\t\n\r\x0bß版") for _ in range(rng.randrange(30))) for _ in range(500)]
    first, h1, h2 = ld.line_hashes(pa.array(texts, pa.string()))
    forms = [" ".join(x.lower().replace("\t", " ").replace("\r", " ").replace("\x0b", " ").split(" ")).split() for t in texts for x in (t or "").split("\n")]
    forms = [" ".join(x) for x in forms]
    assert len(forms) == len(h1) == first[-1] and [b - a for a, b in zip(first, first[1:])] == [(t or "").count("\n") + 1 for t in texts]
    by = {}
    for f, a, b in zip(forms, h1.tolist(), h2.tolist()):
        assert by.setdefault(f, (a, b)) == (a, b) and (f == "") == (a == b == 0)
    assert len(set(by.values())) == len(by) and len({a for a, _ in by.values()}) == len(by)


def test_shuffled_join_gives_the_same_as_the_broadcast(spark, medium, monkeypatch):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = lambda: sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup(docs, counts=True).collect())
    one = rows()
    monkeypatch.setattr(ld, "BROADCAST_LINES", 0)
    assert rows() == one and any(n for *_, n in one)
