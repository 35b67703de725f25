import hashlib

from textloom.llm import warc_fixity as w

SCHEMA = "page_id long, url string, html string"


def pages(n):
    return [(i, f"http://host/{i}", f"body of page {i}") for i in range(n)]


def audit(spark, a, b):
    return w.audit(*(w.records(spark.createDataFrame(x, SCHEMA)) for x in (a, b))).collect()


def records_at_fault(rows):
    return sorted(((r["record_id"], r["copy"], r["status"]) for r in rows if r["level"] == 0), key=repr)


def test_equal_replicas_have_no_difference(spark):
    rows = pages(300)
    assert audit(spark, rows, rows[::-1]) == []


def test_corruption_is_located(spark):
    a = pages(9000)
    b = [(i, u, "rotten" if i in (5, 8190) else h) for i, u, h in a if i != 4100]
    rows = audit(spark, a, b + [(9001, "http://new", "x")])
    assert sorted(records_at_fault(rows)) == [(5, 1, "differs"), (4100, 1, "only in a"), (8190, 1, "differs"), (9001, 1, "only in b")]
    # one branch of each level for each fault, no other: archives 0, 1 and 2; 8190 and 4100 share a root
    assert sorted((r["level"], r["archive"], r["node"]) for r in rows if r["level"]) == [(1, 0, 0), (1, 1, 0), (1, 1, 255), (1, 2, 50), (2, 0, 0), (2, 1, 0), (2, 1, 15), (2, 2, 3), (3, 0, 0), (3, 1, 0), (3, 2, 0)]


def test_offsets_and_digests_are_those_of_the_records(spark):
    rows = pages(40) + [(3, None, None)]
    leaf = w.leaves(w.records(spark.createDataFrame(rows, SCHEMA))).orderBy("slot", "copy").collect()
    at, seen = 0, []
    for r in leaf:
        assert r["start"] == at
        at += r["length"]
        seen.append((r["record_id"], r["copy"]))
    assert seen == [(0, 1), (1, 1), (2, 1), (3, 1), (3, 2), *((i, 1) for i in range(4, 40))]
    text = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:0>\r\nWARC-Target-URI: http://host/0\r\nContent-Length: 14\r\n\r\nbody of page 0\r\n\r\n"
    assert leaf[0]["digest"] == hashlib.sha256(text.encode()).hexdigest() and leaf[0]["length"] == len(text)


def test_nulls_copies_and_empty_replicas(spark):
    a = [(None, None, None), (None, None, "x"), (1, "u", "h"), (1, "u", "h"), (-1, "u", "h")]
    assert audit(spark, a, a) == []
    fault = records_at_fault(audit(spark, a, a[1:4]))
    assert (-1, 1, "only in a") in fault and (None, 2, "only in a") in fault and not any(r[0] == 1 for r in fault)
    lost = audit(spark, a, [])
    assert len([r for r in lost if r["level"] == 0]) == 5 and {r["status"] for r in lost} == {"only in a"}
    assert audit(spark, [], []) == []


def test_one_copy_lost(spark):
    a = [(1, "u", "h"), (1, "u", "h"), (2, "u", "h")]
    assert records_at_fault(audit(spark, a, a[1:])) == [(1, 2, "only in a")]


def test_only_bad_zones_are_read_below_the_roots(spark, monkeypatch):
    a = spark.range(0, 4096 * 40, 512).selectExpr("id AS page_id", "'u' AS url", "concat('body ', id) AS html")
    b = a.selectExpr("page_id", "url", "IF(page_id = 4096 * 17 + 512, 'rotten', html) AS html")
    read = []
    real = w._under
    monkeypatch.setattr(w, "_under", lambda nodes, bad: read.append(nodes._jdf.queryExecution().executedPlan().toString()) or real(nodes, bad))
    rows = w.audit(w.records(a), w.records(b)).collect()
    assert records_at_fault(rows) == [(4096 * 17 + 512, 1, "differs")] and len(rows) == 4
    assert len(read) == 6 and all("PartitionFilters: [" in plan and "zone" in plan.split("PartitionFilters: [")[1].split("]")[0] for plan in read)
    many = spark.range(0, 4096 * 1000, 4096).selectExpr("id AS record_id")
    low, size = w.zones(many)
    assert (low, size) == (0, 4)


def test_very_long_bodies_and_clashing_columns(spark):
    rows = [(i, "u", "x" * 2_000_000 + str(i), "d", 1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, zone int, archive int")
    bad = df.selectExpr("page_id", "url", "IF(page_id = 1, concat(html, 'y'), html) AS html", "digest", "zone", "archive")
    assert records_at_fault(w.audit(w.records(df), w.records(bad)).collect()) == [(1, 1, "differs")]
