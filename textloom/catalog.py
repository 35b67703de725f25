"""The registered queries over the test tables, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dedupe, mix, sampling, stats, taggers, threads, tokenize, url_taggers
from .sources import corpus, warc
from .streaming import incremental

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({', '.join(map(quoted, row))})" for row in taggers.tagger_rows())
    return {**_SQL, "tagger_list": f"SELECT name, kind, doc FROM (VALUES {rows}) v(name, kind, doc)"}


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table up to which it is spread over the cores before it is tagged; larger ones come in partitions enough.
_SMALL = 1 << 30


def _docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents; a small table, which may be a single row group, is spread over the cores once, as taggers cost more than that."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", *more)
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return docs.repartition(spark.sparkContext.defaultParallelism, "id") if int(str(size)) < _SMALL else docs


_WORD = r"regexp_extract_all(text, '[\pL\pN\pM\p{Pc}]+|[^\pL\pN\pM\p{Pc}\s]+')"
_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_LENGTHS = {"bytes_length_v1": ("bytes", "strlen(text)"), "doc_count_v1": ("count", "1"), "char_length_v1": ("length", "length(text)"), "char_length_strip_ws_v1": ("length", f"length({_TRIM})"), "whitespace_tokenizer_v1": ("length", f"len({_WORD}) + 1")}


@_query(" UNION ALL ".join(f"SELECT doc_id AS id, 'exp' AS experiment, '{t}' AS tagger, '{k}' AS type, 0::BIGINT AS start, length(text)::BIGINT AS \"end\", ({v})::DOUBLE AS score FROM documents WHERE text IS NOT NULL" for t, (k, v) in _LENGTHS.items()))
def tag_lengths(spark, sf_dir):
    return taggers.spans(taggers.tag(_docs(spark, sf_dir), _LENGTHS))


_LINES = r"""lines AS (
  SELECT id, text, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT doc_id AS id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents))"""


@_query(rf"""WITH {_LINES},
p AS (SELECT *, least(start + length(line) + 1, length(text))::BIGINT AS stop FROM lines)
SELECT id, 'exp' AS experiment, 'char_length_with_paragraphs_v1' AS tagger, 'paragraph' AS type, start, stop AS "end", (stop - start)::DOUBLE AS score FROM p WHERE NOT regexp_full_match(line, '\s*')
UNION ALL SELECT doc_id, 'exp', 'char_length_with_paragraphs_v1', 'document', 0, length(text), length(text)::DOUBLE FROM documents""")
def tag_paragraph_lengths(spark, sf_dir):
    return taggers.spans(taggers.tag(_docs(spark, sf_dir), ["char_length_with_paragraphs_v1"]))


def _c4_sql(name: str, script: str) -> str:
    naughty = "list_has_any(string_split_regex(lower(text), '\\s+'), ['viagra', 'porn', 'xxx']) OR contains(lower(text), 'hardcore sex')"
    flags = {"has_naughty_word": naughty, "has_javascript": script, "has_lorem_ipsum": "contains(lower(text), 'lorem ipsum')", "has_curly_brace": "contains(text, '{')"}
    head = f"'exp' AS experiment, '{name}' AS tagger"
    return rf"""WITH {_LINES},
p AS (SELECT *, least(start + length(line) + 1, length(text))::BIGINT AS stop, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM lines)
SELECT id, {head}, 'lines_with_no_ending_punctuation' AS type, start, stop AS "end", 1.0::DOUBLE AS score FROM p WHERE NOT regexp_matches(s, '[.?!"]$')
UNION ALL SELECT id, {head}, 'lines_with_too_few_words', start, stop, 1.0::DOUBLE FROM p WHERE len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) < 3
UNION ALL SELECT doc_id, {head}, 'line_count', 0, length(text), len(string_split(text, chr(10)))::DOUBLE FROM documents
""" + "".join(f"UNION ALL SELECT doc_id, {head}, '{k}', 0, length(text), 1.0::DOUBLE FROM documents WHERE {c}\n" for k, c in flags.items())


@_query(_c4_sql("c4_v1", r"list_contains(string_split_regex(lower(text), '\s+'), 'javascript')"))
def tag_c4_v1(spark, sf_dir):
    return taggers.spans(taggers.tag(_docs(spark, sf_dir), ["c4_v1"]))


@_query(_c4_sql("c4_v2", "contains(lower(text), 'javascript')"))
def tag_c4_v2(spark, sf_dir):
    return taggers.spans(taggers.tag(_docs(spark, sf_dir), ["c4_v2"]))


def _gopher_sql(name: str, cut: str) -> str:
    """Every score of every document, by explosion to lines and n-grams."""
    base = {
        "character_count": "length(text)", "word_count": "len(w)", "median_word_length": "coalesce(list_median(list_transform(w, lambda x: length(x))), 0)",
        "symbol_to_word_ratio": "len(list_filter(w, lambda x: contains(x, '#') OR contains(x, '…'))) / greatest(len(w), 1)",
        "fraction_of_words_with_alpha_character": "len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) / greatest(len(w), 1)",
        "required_word_count": "len(list_filter(w, lambda x: x IN ('the', 'be', 'to', 'of', 'and', 'that', 'have', 'with')))",
        "fraction_of_lines_starting_with_bullet_point": "len(list_filter(l, lambda x: x <> '' AND x[1] IN ('*', '-'))) / len(l)",
        "fraction_of_lines_ending_with_ellipsis": "len(list_filter(l, lambda x: x <> '' AND x[-1] = '…')) / len(l)",
        "fraction_of_duplicate_lines": "coalesce(again, 0) / len(l)", "fraction_of_characters_in_duplicate_lines": "coalesce(again_chars, 0) / greatest(chars, 1)",
    }
    head = f"'exp' AS experiment, '{name}' AS tagger"
    parts = [f"SELECT id, {head}, '{k}' AS type, 0::BIGINT AS start, length(text)::BIGINT AS \"end\", CASE WHEN text = '' THEN 0 ELSE printf('%.5f', ({v})::DOUBLE)::DOUBLE END AS score FROM d" for k, v in base.items()]
    parts.append(f"SELECT id, {head}, 'fraction_of_characters_in_most_common_' || n || 'grams', 0, size, printf('%.5f', arg_max(many * c, (many, -first))::DOUBLE / greatest(any_value(chars), 1))::DOUBLE FROM c WHERE n <= 4 GROUP BY id, n, size")
    parts.append(f"SELECT id, {head}, 'fraction_of_characters_in_duplicate_' || n || 'grams', 0, size, printf('%.5f', coalesce(sum(many * c) FILTER (many > 1), 0)::DOUBLE / greatest(sum(many * c), 1))::DOUBLE FROM c WHERE n > 4 GROUP BY id, n, size")
    return rf"""WITH g AS (
  SELECT doc_id AS id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w, string_split_regex(text, '{cut}') AS l FROM documents),
line AS (SELECT id, x, count(*) AS k FROM (SELECT id, unnest(l) AS x FROM g) GROUP BY ALL HAVING count(*) > 1),
twice AS (SELECT id, sum(k) AS again, sum(k * length(x)) AS again_chars FROM line GROUP BY id),
d AS (SELECT g.*, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars, again, again_chars FROM g LEFT JOIN twice USING (id)),
n AS (
  SELECT id, n, chars, size, i, hash(gram) AS h, length(gram) - n + 1 AS c
  FROM (SELECT id, n, chars, length(text)::BIGINT AS size, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], chr(1)))) AS gram FROM d, (SELECT unnest(range(2, 11)) AS n))),
c AS (SELECT id, n, size, any_value(chars) AS chars, h, count(*) AS many, min(i) AS first, any_value(c) AS c FROM n GROUP BY id, n, size, h)
""" + "\nUNION ALL ".join(parts)


@_query(_gopher_sql("gopher_v1", r"\n"))
def tag_gopher_v1(spark, sf_dir):
    return taggers.spans(taggers.tag(_docs(spark, sf_dir), ["gopher_v1"]))


@_query(_gopher_sql("gopher_v2", r"\n+"))
def tag_gopher_v2(spark, sf_dir):
    return taggers.spans(taggers.tag(_docs(spark, sf_dir), ["gopher_v2"]))


@_query(r"""WITH g AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id AS id, len(w)::DOUBLE AS word_count, len(list_filter(w, lambda x: x IN ('the', 'be', 'to', 'of', 'and', 'that', 'have', 'with')))::DOUBLE AS required_word_count,
  coalesce(list_median(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS median_word_length FROM g""")
def gopher_counts(spark, sf_dir):
    rows = taggers.spans(taggers.tag(_docs(spark, sf_dir), ["gopher_v1"]))
    return rows.groupBy("id").pivot("type", ["word_count", "required_word_count", "median_word_length"]).agg(F.first("score"))


_OTHER = ["pii_regex_with_counts_fast_v2", "pii_regex_v2", "repetitions_v1", "not_alphanum_paragraph_v1", "uniseg_length_paragraphs_with_doc_length_v1", "pretokenizer_with_paragraphs_v1", "code_secrets_v1", "code_redpajama_taggers_v1", "code_copyright_comments_v1", "code_composition", "code_starcoder_taggers_v2", "random_number_v1", "whitespace_tokenizer_with_paragraphs_v1"]


def _tag_query(name):
    def run(spark, sf_dir):
        return taggers.spans(taggers.tag(_docs(spark, sf_dir), [name]))

    run.__name__ = f"tag_{name}"
    return run


def _whole_sql(name: str, scores: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id AS id, 'exp' AS experiment, '{name}' AS tagger, '{k}' AS type, 0::BIGINT AS start, length(text)::BIGINT AS \"end\", printf('%.5f', ({v})::DOUBLE)::DOUBLE AS score FROM documents" for k, v in scores.items())


def _unit(key: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / pow(2, 52))"


_BARE = "(len(string_split(text, chr(10))) - CASE WHEN text = '' OR text[-1] = chr(10) THEN 1 ELSE 0 END)"
_OTHER_SQL = {
    "random_number_v1": _whole_sql("random_number_v1", {"random": _unit("doc_id", 97)}),
    "code_redpajama_taggers_v1": _whole_sql("code_redpajama_taggers_v1", {
        "max_line_length_doc": "list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))",
        "avg_line_length_doc": f"CASE WHEN {_BARE} > 0 THEN (length(text) - length(regexp_replace(text, '[^\n]', '', 'g'))) / {_BARE} ELSE 0 END",
        "alnum_prop_doc": r"CASE WHEN text <> '' THEN length(regexp_replace(text, '[^\pL\pN]', '', 'g')) / length(text) ELSE 0 END",
        "alpha_token_prop_doc": r"CASE WHEN regexp_matches(text, '\S') THEN length(regexp_replace(text, '[^\pL]', '', 'g')) / len(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\s]')) ELSE 0 END",
    }),
    "code_starcoder_taggers_v2": _whole_sql("code_starcoder_taggers_v2", {"has_xml_template_doc": "CASE WHEN contains(left(text, 100), '<?xml version=') THEN 1 ELSE 0 END", "num_github_stars_doc": "0", "code_to_comment_ratio_doc": "0.5", "code_to_text_ratio_html_doc": "1"}),
    "whitespace_tokenizer_with_paragraphs_v1": rf"""WITH {_LINES},
p AS (SELECT *, least(start + length(line) + 1, length(text))::BIGINT AS stop, len({_WORD.replace("(text,", "(line,")}) + 1 AS many FROM lines WHERE NOT regexp_full_match(line, '\s*'))
SELECT id, 'exp' AS experiment, 'whitespace_tokenizer_with_paragraphs_v1' AS tagger, 'paragraph' AS type, start, stop AS "end", many::DOUBLE AS score FROM p
UNION ALL SELECT doc_id, 'exp', 'whitespace_tokenizer_with_paragraphs_v1', 'document', 0, length(text), coalesce((SELECT sum(many) FROM p WHERE p.id = doc_id), 0)::DOUBLE FROM documents""",
    "not_alphanum_paragraph_v1": rf"""WITH {_LINES},
p AS (SELECT *, least(start + length(line) + 1, length(text))::BIGINT AS stop FROM lines WHERE NOT regexp_full_match(line, '\s*') AND NOT regexp_matches(line, '[a-zA-Z0-9]') AND regexp_full_match(line, '[\pP\pS\s]+'))
SELECT id, 'exp' AS experiment, 'not_alphanum_paragraph_v1' AS tagger, 'all_punct' AS type, start, stop AS "end", 1.0::DOUBLE AS score FROM p
UNION ALL SELECT doc_id, 'exp', 'not_alphanum_paragraph_v1', 'all_punct', 0, length(text), 0.0 FROM documents WHERE doc_id NOT IN (SELECT id FROM p)""",
}

for _name in _OTHER:
    _query(_OTHER_SQL.get(_name))(_tag_query(_name))


@_query()
def tag_licence_links(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.coalesce("html", F.lit("")).alias("html"))
    return taggers.tag(pages, ["cc_re", "cc_re_fast"])


@_query("SELECT doc_id AS id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN strlen(text)::BIGINT END AS duplicate_bytes FROM documents")
def dedupe_documents(spark, sf_dir):
    found = dedupe.dedupe_documents(_docs(spark, sf_dir))
    return found.select("id", F.get("duplicates", F.lit(0))["end"].alias("duplicate_bytes"))


@_query("SELECT doc_id AS id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def dedupe_by_field(spark, sf_dir):
    docs = _docs(spark, sf_dir, "source")
    found = dedupe.dedupe_documents(docs, key="source")
    return docs.join(found, "id").where(F.size("duplicates") == 0).select("id", "source")


_PARA = rf"WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY md5(line) ORDER BY id, n) AS k FROM lines)"


@_query(f'{_PARA} SELECT id, start, (start + length(line))::BIGINT AS "end" FROM r WHERE k > 1')
def dedupe_paragraphs(spark, sf_dir):
    return dedupe.dedupe_paragraphs(_docs(spark, sf_dir)).select("id", F.explode("duplicates").alias("s")).select("id", "s.start", "s.end")


@_query(rf"""WITH {_LINES}, e AS (SELECT *, row_number() OVER (PARTITION BY md5(line) ORDER BY id, n) AS k FROM lines WHERE NOT regexp_full_match(line, '\s*') AND length(line) >= 20
  AND len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) >= 4)
SELECT id, start, (start + length(line))::BIGINT AS "end" FROM e WHERE k > 1""")
def dedupe_long_paragraphs(spark, sf_dir):
    found = dedupe.dedupe_paragraphs(_docs(spark, sf_dir), skip_empty=True, min_length=20, min_words=4)
    return found.select("id", F.explode("duplicates").alias("s")).select("id", "s.start", "s.end")


@_query(rf"""WITH {_LINES}, b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark)
SELECT id, count(*) AS paragraphs FROM lines WHERE NOT regexp_full_match(line, '\s*') AND line IN (SELECT line FROM b) GROUP BY id""")
def decontaminate_paragraphs(spark, sf_dir):
    seeds = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("key"))
    found = dedupe.dedupe_paragraphs(_docs(spark, sf_dir), skip_empty=True, seeds=seeds, read_only=True)
    return found.where(F.size("duplicates") > 0).select("id", F.size("duplicates").cast("long").alias("paragraphs"))


@_query()
def dedupe_ngrams(spark, sf_dir):
    found = dedupe.dedupe_ngrams(_docs(spark, sf_dir), ngram_length=8, stride=1, threshold=0.5)
    return found.select("id", F.explode("duplicates").alias("s")).select("id", "s.*")


@_query(rf"""{_PARA} SELECT d.doc_id AS id, coalesce(r.text, '') AS text FROM documents d
JOIN (SELECT id, string_agg(CASE WHEN k = 1 THEN line ELSE '' END, chr(10) ORDER BY n) AS text FROM r GROUP BY id) r ON r.id = d.doc_id""")
def remove_duplicate_paragraphs(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return dedupe.remove_spans(docs, dedupe.dedupe_paragraphs(docs))


def _tagged(spark, sf_dir):
    return taggers.with_attributes(_docs(spark, sf_dir, "lang", "source"), ["char_length_v1", "whitespace_tokenizer_v1", "c4_v1"])


@_query(rf"SELECT doc_id AS id, lang, text FROM documents WHERE length(text) < 2000 AND NOT (len({_WORD}) + 1 < 20)")
def mix_jsonpath(spark, sf_dir):
    docs = _tagged(spark, sf_dir)
    length, words = "exp__char_length_v1__length", "exp__whitespace_tokenizer_v1__length"
    stream = mix.Stream(include=[f"$.attributes[?(@.{length} && @.{length}[0] && @.{length}[0][2] < 2000)]"], exclude=[f"$.attributes[?(@.{words}[0][2] < 20)]"], discard_fields=["source", "attributes"])
    return mix.mix(docs, stream)


@_query("SELECT doc_id AS id, lang, text FROM documents WHERE lang = 'en' AND length(text) + strlen(text) > 3000 AND source <> 'src0'")
def mix_jq(spark, sf_dir):
    docs = taggers.with_attributes(_docs(spark, sf_dir, "lang", "source"), ["char_length_v1", "bytes_length_v1"])
    stream = mix.Stream(syntax="jq", include=['.lang == "en" and (.attributes.exp__char_length_v1__length[0][2] + .attributes.exp__bytes_length_v1__bytes[0][2] > 3000)'], exclude=['.source == "src0"'], discard_fields=["source", "attributes"])
    return mix.mix(docs, stream)


@_query(rf"""WITH {_LINES}
SELECT id, string_agg(CASE WHEN NOT regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '[.?!"]$') AND (length(line) > 0 OR start < length(text))
  THEN '[CUT]' ELSE line || CASE WHEN start + length(line) < length(text) THEN chr(10) ELSE '' END END, '' ORDER BY n) AS text
FROM lines GROUP BY id HAVING strlen(regexp_replace(string_agg(CASE WHEN NOT regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '[.?!"]$') AND (length(line) > 0 OR start < length(text))
  THEN '[CUT]' ELSE line || CASE WHEN start + length(line) < length(text) THEN chr(10) ELSE '' END END, '' ORDER BY n), '^\s+|\s+$', '', 'g')) >= 200""")
def mix_replace_spans(spark, sf_dir):
    docs = _tagged(spark, sf_dir)
    stream = mix.Stream(span_replacement=[mix.SpanReplacement("$.attributes.exp__c4_v1__lines_with_no_ending_punctuation", "[CUT]", min_score=0.5)], min_text_length=200, discard_fields=["attributes", "lang", "source"])
    return mix.mix(docs, stream)


@_query("SELECT doc_id AS id, text FROM documents WHERE length(text) >= 500 AND strlen(text) < 5000")
def mix_joined(spark, sf_dir):
    """Two sets of attributes, as they would be read from storage, joined to the documents."""
    docs = _docs(spark, sf_dir)
    sets = [taggers.tag(docs, ["char_length_v1"]), taggers.tag(docs, ["bytes_length_v1"])]
    stream = mix.Stream(include=["$.attributes[?(@.exp__char_length_v1__length[0][2] >= 500)]"], exclude=["$.attributes[?(@.exp__bytes_length_v1__bytes[0][2] >= 5000)]"], discard_fields=["attributes"])
    return mix.mix(docs, stream, sets)


@_query(r"""SELECT name, 'score' AS metric, count(*) AS n, sum(v)::DOUBLE AS total, min(v)::DOUBLE AS lowest, max(v)::DOUBLE AS highest
FROM (SELECT 'exp__char_length_v1__length' AS name, length(text)::DOUBLE AS v FROM documents UNION ALL SELECT 'exp__bytes_length_v1__bytes', strlen(text)::DOUBLE FROM documents) GROUP BY name
UNION ALL SELECT unnest(['exp__char_length_v1__length', 'exp__bytes_length_v1__bytes']), 'length', count(*), sum(length(text))::DOUBLE, min(length(text))::DOUBLE, max(length(text))::DOUBLE FROM documents""")
def attribute_summary(spark, sf_dir):
    return stats.summarize(taggers.tag(_docs(spark, sf_dir), ["char_length_v1", "bytes_length_v1"]))


@_query()
def attribute_histograms(spark, sf_dir):
    return stats.histograms(taggers.tag(_docs(spark, sf_dir), ["char_length_v1", "random_number_v1"]), bins=20)


@_query()
def attribute_histograms_by_count(spark, sf_dir):
    return stats.histograms(taggers.tag(_docs(spark, sf_dir), ["char_length_v1"]), bins=20, by_count=True)


@_query(r"""WITH v AS (SELECT length(text)::DOUBLE AS v FROM documents),
e AS (SELECT v, CASE WHEN v = 0 THEN 0 ELSE length(bin(v::BIGINT)) END AS exponent FROM v)
SELECT exponent::INTEGER AS exponent, CASE WHEN v = 0 THEN 0 ELSE floor(v / pow(2, exponent) * 100000) END::BIGINT AS mantissa, count(*) AS n, sum(v)::DOUBLE AS total FROM e GROUP BY 1, 2""")
def value_buckets(spark, sf_dir):
    return stats.value_buckets(_docs(spark, sf_dir).select(F.length("text").cast("double").alias("value")))


@_query(r"""WITH d AS (SELECT source, lang, text, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT source, lang, count(*) AS documents, sum(len(w))::BIGINT AS words, sum(length(text))::BIGINT AS characters, sum(strlen(text))::BIGINT AS bytes,
  sum(len(list_filter(w, lambda x: x IN ('she', 'her', 'hers', 'herself'))))::BIGINT AS pronouns_she, sum(len(list_filter(w, lambda x: x IN ('he', 'him', 'his', 'himself'))))::BIGINT AS pronouns_he,
  sum(len(list_filter(w, lambda x: x IN ('they', 'them', 'their', 'theirs', 'themselves'))))::BIGINT AS pronouns_they FROM d GROUP BY source, lang""")
def corpus_stats(spark, sf_dir):
    return stats.corpus_stats(_docs(spark, sf_dir, "source", "lang"), ["source", "lang"])


@_query("SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1 ORDER BY pages DESC, host LIMIT 20")
def top_hosts(spark, sf_dir):
    return stats.host_stats(_table(spark, sf_dir, "pages"), 20)


_GRAMS = r"""WITH d AS (SELECT list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS ngram FROM d)
SELECT ngram, count(*) AS n FROM g GROUP BY ngram"""


@_query(_GRAMS + " HAVING count(*) >= 3")
def ngram_counts(spark, sf_dir):
    return stats.ngram_counts(_docs(spark, sf_dir), 3, least=3)


@_query(_GRAMS + " ORDER BY n DESC, ngram LIMIT 50")
def top_ngrams(spark, sf_dir):
    return stats.top_ngrams(_docs(spark, sf_dir), 3, 50)


@_query("""SELECT 'long' AS rule, count(*) AS documents, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM documents WHERE length(text) > 3000
UNION ALL SELECT 'short', count(*), coalesce(sum(length(text)), 0)::BIGINT FROM documents WHERE length(text) < 100""")
def rule_coverage(spark, sf_dir):
    name = "exp__char_length_v1__length"
    return stats.rule_coverage(taggers.tag(_docs(spark, sf_dir), ["char_length_v1"]), {"long": (name, ">", 3000.0), "short": (name, "<", 100.0)})


@_query("SELECT doc_id AS id, text FROM documents WHERE right(md5(text), 1) >= 'e'")
def hash_sample(spark, sf_dir):
    return sampling.hash_sample(_docs(spark, sf_dir), 0.1)


@_query("SELECT doc_id AS id, text FROM documents WHERE right(md5(text), 1) <> 'f'")
def hash_sample_complement(spark, sf_dir):
    return sampling.hash_sample(_docs(spark, sf_dir), 1 / 16, complement=True)


@_query(r"SELECT doc_id AS id, text FROM documents WHERE NOT regexp_full_match(text, '\s*')")
def without_empty(spark, sf_dir):
    return sampling.without_empty(_docs(spark, sf_dir))


@_query(f"SELECT doc_id AS id, text FROM documents WHERE {_unit('doc_id')} < 0.25")
def random_sample(spark, sf_dir):
    return _docs(spark, sf_dir).where(sampling.random_share(F.col("id"), 0.25))


@_query("""WITH s AS (SELECT source AS topic, sum(length(text)) AS n FROM documents GROUP BY source), w AS (SELECT topic, 1.0 + (row_number() OVER (ORDER BY topic)) % 3 AS weight FROM s)
SELECT topic, round(weight / (SELECT sum(weight) FROM w) * 1000000 / n, 9)::DOUBLE AS rate FROM s JOIN w USING (topic)""")
def mixture_rates(spark, sf_dir):
    from pyspark.sql.window import Window

    sizes = _docs(spark, sf_dir, "source").groupBy(F.col("source").alias("topic")).agg(F.sum(F.length("text")).alias("n_tokens"))
    wanted = sizes.select("topic", (1.0 + F.row_number().over(Window.orderBy("topic")) % 3).alias("weight"))  # a row for each topic
    return sampling.mixture_rates(sizes, wanted, 1_000_000).select("topic", F.round("rate", 9).alias("rate"))


@_query(f"SELECT id, unnest(range(1, n + 1))::INTEGER AS copy FROM (SELECT doc_id AS id, 2 + ({_unit('doc_id')} < 2.4::DOUBLE - 2)::INTEGER AS n FROM documents)")
def resampled(spark, sf_dir):
    return sampling.resample(_docs(spark, sf_dir).select("id"), 2.4, F.col("id"))


@_query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def conversation_texts(spark, sf_dir):
    return threads.conversations(_table(spark, sf_dir, "conversations"))


@_query("SELECT source, lang, string_agg(text, chr(10) || '---' || chr(10) ORDER BY doc_id) AS text, count(*) AS files_concatenated FROM documents GROUP BY source, lang")
def concatenated_files(spark, sf_dir):
    return threads.concat_files(_docs(spark, sf_dir, "source", "lang"), ["source", "lang"], ["id"], "\n---\n")


@_query()
def comment_threads(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    name = lambda n: F.concat_ws("-", F.col("conv_id").cast("string"), n.cast("string"))
    comments = turns.select(F.col("conv_id").cast("string").alias("thread_id"), name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.floor((F.col("turn") - 1) / 2))).otherwise(F.col("conv_id").cast("string")).alias("parent_id"), F.coalesce("text", F.lit("")).alias("body"), F.lit(1).alias("score"))
    return threads.linear_threads(comments)


_LISTED = "regexp_replace(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/:?#]*)', 1), '^[w.]+', '')"


@_query(f"SELECT page_id, {_LISTED} IN ('cheap-pills.example.com', 'm.casino-win.example.com', 'free-bets.example.com') AS listed FROM pages")
def listed_hosts(spark, sf_dir):
    addresses = spark.createDataFrame([("www.cheap-pills.example.com",), ("m.casino-win.example.com",), ("free-bets.example.com",)], "address string")
    return url_taggers.flag_listed(_table(spark, sf_dir, "pages"), addresses, by="host").select("page_id", "listed")


@_query(r"SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '')), '/+$', '') AS link FROM pages")
def cleaned_links(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", url_taggers.clean_link(F.col("url")).alias("link"))


@_query(r"SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^www\d*\.', '') AS url FROM pages")
def normalized_urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", warc.normalize_url(F.col("url")).alias("url"))


@_query()
def linearized_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", warc.linearized(F.col("html")).alias("text"))


@_query("SELECT doc_id::VARCHAR AS id, text, 'code' AS source, lang, n_chars::VARCHAR AS n_chars FROM documents")
def columns_as_metadata(spark, sf_dir):
    docs = corpus.columns_to_documents(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "lang", "n_chars"), id_col="doc_id", source="code")
    return docs.select("id", "text", "source", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["n_chars"].alias("n_chars"))


@_query("SELECT md5(text) AS id, text, 'web' AS source FROM documents")
def hashed_ids(spark, sf_dir):
    return corpus.hashed_documents(_table(spark, sf_dir, "documents"), "text", "web").select("id", "text", "source")


@_query("SELECT '__label__' || source || ' ' || regexp_replace(replace(text, chr(10), ' '), '^ +| +$', '', 'g') AS value FROM documents WHERE regexp_replace(replace(text, chr(10), ' '), '^ +| +$', '', 'g') <> ''")
def classifier_lines(spark, sf_dir):
    return tokenize.training_lines(_docs(spark, sf_dir, "source"), "source")


@_query("SELECT doc_id AS id, replace(replace(text, 'the', '<a>'), '<a>n', 'then') AS text FROM documents")
def sanitized(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("text", tokenize.sanitize(F.col("text"), [("the", "<a>"), ("<a>n", "then")]))


@_query()
def filled_in_middle(spark, sf_dir):
    return tokenize.fill_in_middle(_docs(spark, sf_dir), rate=0.5)


@_query(rf"""WITH c AS (SELECT doc_id AS id, len(string_split_regex(text, '\s+'))::BIGINT AS n_tokens, floor({_unit('doc_id')} * 16)::BIGINT AS shard, {_unit('doc_id', 1)} AS u FROM documents),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY shard ORDER BY u, id)::BIGINT AS "end" FROM c)
SELECT id, n_tokens, shard, "end", "end" - n_tokens AS start FROM s""")
def token_places(spark, sf_dir):
    counted = _docs(spark, sf_dir).select("id", F.size(F.split("text", r"\s+")).cast("long").alias("n_tokens"))
    return tokenize.token_offsets(counted, shards=16)


@_query("SELECT doc_id AS id, text FROM documents")
def shuffled_documents(spark, sf_dir):
    return tokenize.shuffled(_docs(spark, sf_dir))


@_query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    return incremental.windowed_counts(_table(spark, sf_dir, "events"), ["event_type"], size="1 day")


@_query()
def tagger_list(spark, sf_dir):
    return taggers.tagger_table(spark)
