import numpy as np
import pyarrow as pa

from textloom.llm import quality_rules as q
from textloom.llm import textbatch as tb


def _texts(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("the", "ran", "sil", "mor", "tel") for b in ("der", "ing", "ous", "ent", "al")]
    texts, y = [], []
    for _ in range(n):
        ws = list(rng.choice(words, rng.integers(20, 200)))
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            ws = [w + "$$$" for w in ws]
        if toxic:
            for _ in range(3):
                ws[rng.integers(len(ws))] = "vile"
        texts.append(" ".join(ws))
        y.append((0 if bad else 1, int(toxic)))
    return pa.array(texts, pa.large_string()), np.array(y, float)


def test_held_out_accuracy_and_calibration():
    texts, y = _texts(600)
    model = q.train(texts, y)
    test, t = _texts(400, seed=1)
    p = model.probabilities(test)
    assert ((p[:, 0] > 0.5) == (t[:, 0] > 0)).mean() > 0.97
    assert ((p[:, 1] > 0.5) == (t[:, 1] > 0)).mean() > 0.95
    assert abs(p[:, 0].mean() - t[:, 0].mean()) < 0.05 and abs(p[:, 1].mean() - t[:, 1].mean()) < 0.08


def test_model_survives_serialisation_and_batching():
    texts, y = _texts(200)
    model = q.train(texts, y)
    again = q.Model.from_bytes(model.to_bytes())
    whole = again.margins(texts)
    assert np.allclose(model.margins(texts), whole)
    one = np.concatenate([again.margins(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.allclose(one, whole)


def test_long_text_counts_to_its_end():
    texts, y = _texts(600)
    model = q.train(texts, y)
    clean = " ".join(texts[int(np.flatnonzero((y[:, 0] > 0) & (y[:, 1] == 0))[0])].as_py().split()[:20])
    long = pa.array([(clean + " ") * 3000, (clean + " ") * 3000 + "vile " * 4000], pa.large_string())
    p = model.probabilities(long)
    assert p[0, 1] < 0.5 < p[1, 1]


def test_edge_rows(spark):
    texts, y = _texts(300)
    docs = spark.createDataFrame([(i, t.as_py(), "x") for i, t in enumerate(texts)] + [(None, None, "x"), (7000, "", "x"), (7001, "  \n", "x"), (5, texts[5].as_py(), "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(y)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = q.fit(docs, labels)
    rows = q.quality_rules(docs, model).collect()
    assert len(rows) == 304
    blank = [r for r in rows if r["doc_id"] in (None, 7000, 7001)]
    assert len(blank) == 3 and all(r["p_quality"] == 0 and not r["keep"] for r in blank)
    five = [r for r in rows if r["doc_id"] == 5]
    assert len(five) == 2 and five[0] == five[1]
    kept = q.quality_filter(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["keep"])


def test_no_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.fit(docs, none)
    assert [r["keep"] for r in q.quality_rules(docs, model).collect()] == [True]
    assert q.quality_rules(docs.limit(0), model).collect() == []


def test_tables(spark, medium):
    rows = {r["doc_id"]: r for r in q.query(spark, medium).collect()}
    labels = spark.read.parquet(f"{medium}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{medium}/documents.parquet").count()
    good = [rows[r["doc_id"]]["keep"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean(good) > 0.97


def test_toxic_words_in_other_case_or_with_punctuation_count():
    texts, y = _texts(600)
    model = q.train(texts, y)
    test, t = _texts(400, seed=1)
    for form in ("VILE", "vile!!", "Vile###", "(vile)"):
        p = model.probabilities(pa.array([x.replace("vile", form) for x in test.to_pylist()], pa.large_string()))
        assert ((p[:, 1] > 0.5) == (t[:, 1] > 0)).mean() > 0.95, form


def test_held_out_rejects_of_the_tables(medium):
    import pyarrow.parquet as pq

    folder = medium.replace("sf0.01", "sf0.1")
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pandas().set_index("doc_id").text
    rows = pq.read_table(f"{folder}/labels.parquet").to_pandas().sort_values("doc_id")
    rows = rows[rows.doc_id.isin(texts.index)]
    rows["text"] = texts.loc[rows.doc_id].values
    rows = rows[rows.text.fillna("").str.strip() != ""].sample(frac=1, random_state=0)
    fit, held = rows[: len(rows) * 2 // 3], rows[len(rows) * 2 // 3 :]
    model = q.train(pa.array(fit.text.tolist(), pa.large_string()), fit[["quality", "toxic"]].to_numpy(float))
    p = model.probabilities(pa.array(held.text.tolist(), pa.large_string()))
    keep = (p[:, 0] >= q.LEAST_QUALITY) & (p[:, 1] < q.MOST_TOXIC)
    bad, toxic = (held.quality == 0).to_numpy(), (held.toxic == 1).to_numpy()
    assert keep[bad].mean() < 0.2 and keep[toxic].mean() < 0.28 and keep[~bad & ~toxic].mean() > 0.98


def plain_buckets(text):
    """Buckets of a text's words, pairs and character n-grams by plain loops, for each view of it."""
    mask, out = (1 << 64) - 1, []

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    def poly(data):
        return sum((b + 1) * pow(tb._BASES[0], i, 1 << 64) for i, b in enumerate(data)) & mask

    for lower in (False, True):
        chars = text.lower() if lower else text
        chars = "".join(" " if lower and ord(c) < 128 and not c.isalnum() else c for c in chars)
        words = [mix(poly(w.encode())) for w in chars.split()]
        shift = 64 - q.BITS
        out.append([h >> shift for h in words])
        out.append([mix(a * 31 + b & mask) >> shift for a, b in zip(words, words[1:])])
        for n in q.CHAR_ORDERS:
            keys = [poly(chars[i : i + n].encode()) for i in range(len(chars) - n + 1)]
            out.append([((k ^ k >> 32) * 0xD6E8FEB86659FD93 & mask) >> shift for k in keys])
    return out


def test_features_margins_and_calibration_against_plain_loops():
    texts = ["Some WORDS, äöü some words!", "a", "", "版权 所有 x", "one two  three\nfour"]
    rng = np.random.default_rng(3)
    model = q.Model(rng.normal(size=(2, 4, 1 << q.BITS)).astype(np.float32), np.array([0.3, -0.2]), np.array([1.5, 0.7]), np.array([0.1, -0.4]))
    got = model.probabilities(pa.array(texts, pa.large_string()))
    for t, (good, toxic) in zip(texts, got):
        groups, want = plain_buckets(t), []
        for head, view in ((0, groups[:4]), (1, groups[4:])):
            z = float(model.bias[head])
            for k, buckets in enumerate(view):
                norm = max(len(buckets), 1) / 50 if head == 0 else max(len(buckets), 1) ** 0.5
                z += sum(float(model.weights[head, 2 * head + (k >= 2)][b]) for b in buckets) / norm
            want.append(1 / (1 + np.exp(-(z * model.slope[head] + model.offset[head]))))
        assert np.allclose((good, toxic), want, atol=1e-6), t


def test_platt_against_gradient_descent():
    rng = np.random.default_rng(4)
    z = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * z - 0.5)))).astype(float)
    slope, offset = q._platt(z, y)
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(20_000):
        err = 1 / (1 + np.exp(-(a * z + b))) - t
        a -= 0.005 * (err @ z + 1e-3 * (a - 1))
        b -= 0.005 * (err.sum() + 1e-3 * b)
    assert abs(a - slope) < 1e-3 and abs(b - offset) < 1e-3


def test_few_labels_are_fitted_too():
    good, bad = "plain good words here", "$$$ @@@ buy $$$ @@@ now"
    for n in (1, 2, 3, 5, 8):
        y = np.array([[1, 0], [0, 1]] * n, float)[:n]
        model = q.train(pa.array([good, bad] * n, pa.large_string()).slice(0, n), y)
        p = model.probabilities(pa.array([good, bad, ""], pa.large_string()))
        assert np.isfinite(p).all() and ((p >= 0) & (p <= 1)).all()


def test_repeated_ids_and_labels_bring_one_row_each(spark):
    texts, y = _texts(60)
    docs = spark.createDataFrame([(i, t.as_py()) for i, t in enumerate(texts)] + [(0, f"other text {k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(y)] * 3, "doc_id long, quality int, toxic int")
    assert np.isfinite(q.fit(docs, labels).bias).all()
    assert [r["keep"] for r in q.quality_rules(docs.limit(0), q.fit(docs, labels.limit(0))).collect()] == []
