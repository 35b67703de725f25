import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.llm import language_fusion as lf

WORDS = {"en": ["the", "of", "and", "with", "that", "which", "have"], "de": ["der", "und", "nicht", "eine", "auch", "werden", "für"], "fr": ["les", "des", "une", "pour", "dans", "être", "avec"]}


def text(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice("aeiou") for _ in range(n))


def train(seed=0):
    rng = random.Random(seed)
    labels = [rng.choice(list(WORDS)) for _ in range(90)]
    return lf.train(pa.array([text(rng, x) for x in labels], pa.large_string()), labels)


def plain_fusion(rows, e, langs):
    """The posterior by plain loops."""
    n = len(langs)
    p = np.exp(e) / np.exp(e).sum(1, keepdims=True)

    def counts(key):
        out = {}
        for r, q in zip(rows, p):
            out.setdefault(key(r), np.zeros(n))
            out[key(r)] = out[key(r)] + q
        return out

    lean = lambda c, prior: (c + lf.LEAN * prior) / (c.sum() + lf.LEAN)
    corpus = (p.sum(0) + 1) / (p.sum() + n)
    kind, suffix, domain, host = (counts(k) for k in (lambda r: r[0], lambda r: (r[0], r[2]), lambda r: (r[0], r[2], r[3]), lambda r: (r[0], r[4])))
    given = []
    for c in (1, 2):
        table = {}
        for r, q in zip(rows, p):
            if r[c] is not None:
                table[(r[0], r[c])] = table.get((r[0], r[c]), np.zeros(n)) + q
        total = {}
        for (k, _), v in table.items():
            s, m = total.get(k, (np.zeros(n), 0))
            total[k] = (s + v, m + 1)
        given.append({(k, v): np.log((x + lf.SMOOTH) / (total[k][0] + lf.SMOOTH * total[k][1])) for (k, v), x in table.items()})
    out = []
    for r, q, ev in zip(rows, p, e):
        prior = lean(domain[(r[0], r[2], r[3])], lean(suffix[(r[0], r[2])], lean(kind[r[0]], corpus)))
        z = ev + sum(g[(r[0], r[c])] for g, c in zip(given, (1, 2)) if r[c] is not None)
        z = z + np.log(lean(np.maximum(host[(r[0], r[4])] - q, 0), prior) if r[4] is not None else prior)
        z = np.exp(z - z.max())
        out.append((langs[int(z.argmax())], z.max() / z.sum()))
    return out


def test_against_plain_loops(spark):
    model, rng = train(), random.Random(2)
    rows, texts = [], []
    for i in range(120):
        lang = rng.choice(list(WORDS))
        suffix = {"de": "de", "fr": "fr", "en": "com"}[lang] if rng.random() < 0.8 else "org"
        host = rng.choice([None, f"{rng.randint(0, 3)}.site.{suffix}"])
        rows.append((rng.choice(["page", "page", "document"]), rng.choice([None, lang, lang, "xx"]), host and suffix, host and f"site.{suffix}", host))
        texts.append(rng.choice([text(rng, lang), text(rng, lang, 1), "", None]))
    df = spark.createDataFrame([(r[0], i, None, t, *r[1:]) for i, (r, t) in enumerate(zip(rows, texts))], "kind string, doc_id long, page_id long, text string, declared string, suffix string, domain string, host string")
    got = {r["doc_id"]: (r["lang"], r["probability"]) for r in lf.language_fusion(df, model).collect()}
    want = plain_fusion(rows, model.evidence(pa.array(texts, pa.large_string())), model.langs)
    assert len(got) == len(rows)
    for i, (lang, p) in enumerate(want):
        assert abs(got[i][1] - p) < 1e-6 and (got[i][0] == lang or p < 0.5)


def test_other_evidence_decides_where_text_is_silent(spark):
    model, rng = train(), random.Random(3)
    rows = [("page", i, None, text(rng, "de"), "de", "de", "a.de", "www.a.de") for i in range(20)] + [("page", i, None, text(rng, "en"), "en", "com", "b.com", "b.com") for i in range(20, 60)]
    rows += [("page", 98, None, None, None, "de", "a.de", "www.a.de"), ("page", 99, None, "", "de", None, None, None)]
    df = spark.createDataFrame(rows, "kind string, doc_id long, page_id long, text string, declared string, suffix string, domain string, host string")
    got = {r["doc_id"]: r for r in lf.language_fusion(df, model).collect()}
    assert got[98]["lang"] == got[99]["lang"] == "de" and got[98]["text_lang"] == lf.UNKNOWN
    assert all(got[i]["lang"] == ("de" if i < 20 else "en") for i in range(60))


def test_page_columns(spark):
    pages = spark.createDataFrame([(1, "https://user@WWW.Site.co.FR:80/x?y", "<!DOCTYPE html><HTML class=a lang='fr-FR'><script>var x='<p>no';</script><p>oui<!-- non --><b>!</b>", "h"), (2, None, None, "h"), (3, "not a url", "<p lang=de>", "h")], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in lf.page_rows(pages).collect()}
    assert (got[1]["host"], got[1]["domain"], got[1]["suffix"], got[1]["declared"]) == ("www.site.co.fr", "site.co.fr", "fr", "fr")
    assert got[1]["text"].split() == ["oui", "!"]
    assert all(got[2][c] is None for c in ("host", "domain", "suffix", "declared", "text")) and got[3]["declared"] is None


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "text", "s", None), (None, None, None, None)], "doc_id long, text string, source string, lang string")
    model = lf.fit(docs)
    assert [(r["lang"], r["probability"]) for r in lf.language_fusion(lf.document_rows(docs), model).collect()] == [("und", 0.0)] * 2
    assert lf.language_fusion(lf.document_rows(docs.limit(0)), train()).collect() == []


def test_tables(spark, medium):
    rows = lf.query(spark, medium).toPandas()
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows[rows.kind == "document"].merge(docs, on="doc_id", suffixes=("", "_true"))
    assert len(both) == len(docs) and (both.lang == both.lang_true).mean() > 0.98
    assert len(rows) == len(docs) + spark.read.parquet(f"{medium}/pages.parquet").count()


def test_domains(spark):
    hosts = {"a.b.example.co.uk": "example.co.uk", "example.com.au": "example.com.au", "www.example.com": "example.com", "co.uk": "co.uk", "host": "host", "x.y.z": "y.z", "echo.uk": "echo.uk", "a.echo.uk": "echo.uk"}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: r["d"] for r in df.select("host", lf.domain_of(df.host).alias("d")).collect()} == hosts


def test_fit_without_ids_or_with_one_reads_no_more_than_train_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 7]), text(rng, lang), lang) for lang in WORDS for _ in range(60)]
    docs = spark.createDataFrame(rows + rows[:1] * 500, "doc_id long, text string, lang string")
    few = lf.fit(docs, train_rows=50)
    assert few.langs == sorted(WORDS)
    h = docs.dropDuplicates().select(F.xxhash64("doc_id", "text", F.lit(13)).alias("h"), "text", "lang").toPandas().sort_values("h")
    bound = sorted(docs.select(F.xxhash64("doc_id", "text", F.lit(13)).alias("h")).toPandas().h)[49]
    chosen = h[h.h <= bound]
    assert len(chosen) <= 50
    assert np.allclose(few.table, lf.train(pa.array(chosen.text.tolist(), pa.large_string()), chosen.lang.tolist()).table, atol=1e-5)


def test_long_repeated_and_tied_rows_and_extra_columns(spark):
    model, rng = train(), random.Random(6)
    long = text(rng, "fr", 200_000)
    docs = spark.createDataFrame([(1, long, "s", 5, "x"), (2, "", "s", 5, "x"), (2, "", "s", 5, "x"), (3, None, None, 5, "x")], "doc_id long, text string, source string, p int, kind string")
    got = [(r["doc_id"], r["text_lang"], r["lang"], r["probability"]) for r in lf.language_fusion(lf.document_rows(docs), model).collect()]
    assert len(got) == 4 and {x[1:3] for x in got if x[0] == 1} == {("fr", "fr")}
    two = [x for x in got if x[0] == 2]
    assert two[0] == two[1] and two[0][1] == lf.UNKNOWN
    # nothing tells languages apart here: the first by the alphabet
    blank = docs.where("doc_id = 2")
    tied = lf.language_fusion(lf.document_rows(blank), model).collect()
    assert {r["lang"] for r in tied} == {"de"} and all(abs(r["probability"] - 1 / 3) < 1e-9 for r in tied)
