import json

import pytest

from textloom.__main__ import main
from textloom.plans import config


@pytest.fixture
def corpus_dir(tmp_path):
    folder = tmp_path / "documents"
    folder.mkdir()
    texts = ["One line here.\nsame line of words", "other\nsame line of words", "x", "One line here.\nsame line of words"]
    (folder / "a.jsonl").write_text("".join(json.dumps({"id": str(i), "text": t, "source": "s", "metadata": {"n": i}}) + "\n" for i, t in enumerate(texts)))
    return tmp_path


def test_tag_dedupe_mix_stat(spark, corpus_dir):
    docs = str(corpus_dir / "documents")
    config.run_tag(spark, {"documents": docs, "taggers": ["char_length_v1", "c4_v1"], "experiment": "e", "destination": str(corpus_dir / "attributes/e")})
    config.run_dedupe(spark, {"documents": docs, "dedupe": {"name": "dups", "paragraphs": {}}, "destination": str(corpus_dir / "attributes/d")})
    out = config.run_mix(spark, {"streams": [{"name": "m", "documents": docs, "attributes": [str(corpus_dir / "attributes/e"), str(corpus_dir / "attributes/d")], "filter": {"exclude": ["$.metadata[?(@.n == 2)]"]}, "span_replacement": [dict(replacement="", span="$.attributes.dups", min_score=0.5)], "output": {"path": str(corpus_dir / "out"), "discard_fields": ["attributes"], "min_text_length": 2}}]})
    assert {r["id"]: r["text"] for r in out["m"].collect()} == {"0": "One line here.\nsame line of words", "1": "other\n"}
    assert spark.read.json(str(corpus_dir / "out/m")).count() == 2
    rows = config.run_stat(spark, {"attributes": str(corpus_dir / "attributes/e"), "bins": 2, "name_regex": "char_length"}).collect()
    assert sum(r["n"] for r in rows if r["metric"] == "score") == 4
    whole = config.run_dedupe(spark, {"documents": docs, "dedupe": {"documents": {"key": "$.text"}}}).collect()
    assert sorted(r["id"] for r in whole if r["attributes"]["duplicates"]) == ["3"]
    grams = config.run_dedupe(spark, {"documents": docs, "dedupe": {"paragraphs": {"by_ngram": {"ngram_length": 2, "overlap_threshold": 0.5}}}}).collect()
    assert len(next(r for r in grams if r["id"] == "3")["attributes"]["duplicates"]) == 2


def test_loading(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("SOME_NAME", "v")
    (tmp_path / "c.json").write_text(json.dumps({"a": {"b": 1}, "e": "${env:SOME_NAME}", "g": "${glob:" + str(tmp_path) + "/*.json}"}))
    got = config.load(str(tmp_path / "c.json"), ["a.b=2", "a.c=x"])
    assert got == {"a": {"b": 2, "c": "x"}, "e": "v", "g": [str(tmp_path / "c.json")]}
    main(["list"])
    assert "c4_v1" in capsys.readouterr().out


@pytest.mark.parametrize("run,settings", [("tag", {}), ("tag", {"documents": "x", "taggers": ["nope"]}), ("dedupe", {"documents": "x", "dedupe": {}}), ("dedupe", {"documents": "x", "dedupe": {"documents": {}, "paragraphs": {}}}), ("mix", {}), ("stat", {})])
def test_wrong_settings(spark, run, settings):
    with pytest.raises(ValueError):
        getattr(config, f"run_{run}")(spark, settings)
