"""Taggers that walk the text in Python, in Arrow batches."""

from __future__ import annotations

import html.parser
import math
import re
from collections import Counter

import numpy as np
import regex

from .registry import Spans, add_tagger
from .repetitions import repeated

_EDGE = r".\s@,?!;:)("
_OCTET = r"(?:2(?:5[0-5]|[0-4]\d)|[01]?\d{1,2})"
_PII = {
    "EMAIL_ADDRESS": re.compile(rf"[{_EDGE}]*([^\s@]+@[^{_EDGE[1:]}]+?)[{_EDGE}]?\s"),
    "PHONE_NUMBER": re.compile(r"\s+\(?" + r"(\d{3})\)?[-. ]*" + r"(\d{3})[-. ]?" + r"(\d{4})"),
    "IP_ADDRESS": re.compile(rf"(?:{_OCTET}\.){{3}}{_OCTET}".replace(r"\d", "[0-9]")),
}
_VETO = ("isbn", "doi", "#")


_REQUIRED = frozenset("and be have of that the to with".split())


def split_paragraphs(text: str, keep_blank: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, body) of each line with its newline."""
    out, at = [], 0
    for body in text.split("\n"):
        body = text[at : at + len(body) + 1]
        if body and (keep_blank or body.strip()):
            out.append((at, at + len(body), body))
        at += len(body)
    return out


def words_uax29(text: str) -> list[str]:
    """Segments between word boundaries of Unicode's annex 29, white space and all."""
    return [x for x in regex.split(r"(?V1w)\b", text) if x]


_SEGMENTS: dict[str, tuple[str, ...]] = {}


def word_segments(text: str) -> list[str]:
    """The segments that aren't white space.  Blanks always end a segment, so the parts between them are segmented once each and kept."""
    out: list[str] = []
    kept = _SEGMENTS
    for part in text.split():
        its = kept.get(part)
        if its is None:
            its = (part,) if part.isascii() and part.isalnum() else tuple(words_uax29(part))
            if len(kept) < 300_000:
                kept[part] = its
        out += its
    return out


_FIRST = np.zeros(1, np.int64)


def _ngram_shares(ids: np.ndarray, size: np.ndarray, total: int) -> dict[str, float]:
    """Shares of the characters in the most common and in repeated n-grams of words with these numbers and sizes.

    An n-gram's number comes from those of its first n-1 words and of its last, so equal numbers are equal n-grams; those whose first n-1 words
    occur once occur once themselves, so they aren't numbered any more.
    """
    out: dict[str, float] = {}
    many_words = int(ids.max()) + 1 if len(ids) else 0
    chars, at, code = size, np.arange(len(ids)), ids
    for n in range(2, 11):
        if len(ids) < n:
            break
        chars = chars[:-1] + size[n - 1 :]
        if len(at) and at.max() >= len(chars):
            inside = at < len(chars)
            at, code = at[inside], code[inside]
        if not len(at):
            out[f"fraction_of_characters_in_most_common_{n}grams" if n <= 4 else f"fraction_of_characters_in_duplicate_{n}grams"] = float(chars[0] / max(total, 1)) if n <= 4 else 0.0
            continue
        code = code * many_words + ids[at + n - 1]
        order = code.argsort(kind="stable")
        its = code[order]
        first = np.concatenate((_FIRST, (its[1:] != its[:-1]).nonzero()[0] + 1))
        many = np.concatenate((first[1:], [len(order)])) - first
        place = at[order[first]]
        again = many > 1
        if n <= 4:
            top = many.max() if again.any() else 1
            where = place[many == top].min() if top > 1 else 0
            out[f"fraction_of_characters_in_most_common_{n}grams"] = float(top * chars[where] / max(total, 1))
        else:
            out[f"fraction_of_characters_in_duplicate_{n}grams"] = float((many * chars[place])[again].sum() / max(chars.sum(), 1))
        kept = again.repeat(many)
        at, code = at[order[kept]], np.arange(len(first)).repeat(many)[kept]
    return out


def _gopher(text: str, line_break: str) -> Spans:
    scores = dict.fromkeys(("character_count", "word_count", "median_word_length", "symbol_to_word_ratio", "fraction_of_words_with_alpha_character", "required_word_count", "fraction_of_lines_starting_with_bullet_point", "fraction_of_lines_ending_with_ellipsis", "fraction_of_duplicate_lines", "fraction_of_characters_in_duplicate_lines"), 0.0)
    if text:
        words = text.split()
        times = Counter(words)
        number = {w: k for k, w in enumerate(times)}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        size = np.fromiter(map(len, times), np.int64, len(times))[ids]
        n, chars = max(len(words), 1), int(size.sum())
        lines = re.split(line_break, text)
        again = {x: k for x, k in Counter(lines).items() if k > 1}
        scores |= {
            "character_count": len(text),
            "word_count": len(words),
            "median_word_length": float(np.median(size)) if words else 0.0,
            "symbol_to_word_ratio": sum(k for w, k in times.items() if "#" in w or "…" in w) / n,
            "fraction_of_words_with_alpha_character": sum(k for w, k in times.items() if w[0].isalpha() or any(map(str.isalpha, w))) / n,
            "required_word_count": sum(times[w] for w in _REQUIRED),
            "fraction_of_lines_starting_with_bullet_point": sum(x[:1] in ("*", "-") and x != "" for x in lines) / len(lines),
            "fraction_of_lines_ending_with_ellipsis": sum(x[-1:] == "…" for x in lines) / len(lines),
            "fraction_of_duplicate_lines": sum(again.values()) / len(lines),
            "fraction_of_characters_in_duplicate_lines": sum(len(x) * k for x, k in again.items()) / max(chars, 1),
            **_ngram_shares(ids, size, chars),
        }
    return {k: [(0, len(text), v)] for k, v in scores.items()}


@add_tagger("char_length_with_paragraphs_v1")
def char_length_paragraphs():
    """Code points of each paragraph and of the document."""
    return lambda text, _: {"paragraph": [(a, b, b - a) for a, b, _ in split_paragraphs(text)], "document": [(0, len(text), len(text))]}


_TOKENS = re.compile("[^\\w\\s]+|\\w+")


@add_tagger("whitespace_tokenizer_v1")
def whitespace_tokens():
    """Parts between tokens of word characters or of other visible ones: one more than there are tokens."""
    return lambda text, _: {"length": [(0, len(text), len(_TOKENS.findall(text)) + 1)]}


@add_tagger("whitespace_tokenizer_with_paragraphs_v1")
def whitespace_tokens_paragraphs():
    """The same of each paragraph, and their sum."""

    def predict(text, _):
        parts = [(a, b, len(_TOKENS.findall(body)) + 1) for a, b, body in split_paragraphs(text)]
        return {"paragraph": parts, "document": [(0, len(text), sum(n for *_, n in parts))]}

    return predict


#: Words and phrases that a clean text doesn't hold; set_naughty_words() sets a list of one's own before taggers are applied.
NAUGHTY = ["viagra", "porn", "xxx", "hardcore sex"]
_ENDS = set('!".?')
_C4_TYPES = ("lines_with_no_ending_punctuation", "lines_with_too_few_words", "has_naughty_word", "has_javascript", "has_lorem_ipsum", "has_curly_brace")


def set_naughty_words(words: list[str]) -> None:
    NAUGHTY[:] = [w.lower() for w in words]


def _c4(substring: bool, listed: list[str]):
    single, phrases = {w for w in listed if " " not in w}, [w for w in listed if " " in w]

    def predict(text, _):
        out: Spans = {k: [] for k in _C4_TYPES}
        lower, seen, at = text.lower(), set(), 0
        lines = (lower if substring else text).split("\n")
        for k, line in enumerate(lines):
            end = at + len(line) + (k < len(lines) - 1)
            body = line.lower().strip()
            words = body.split()
            seen.update(words)
            if body[-1:] not in _ENDS:
                out["lines_with_no_ending_punctuation"].append((at, end, 1.0))
            if len(words) < 3:
                out["lines_with_too_few_words"].append((at, end, 1.0))
            at = end
        hits = {
            "has_naughty_word": not seen.isdisjoint(single) or any(x in lower for x in phrases),
            "has_javascript": "javascript" in (lower if substring else seen),
            "has_lorem_ipsum": "lorem ipsum" in lower,
            "has_curly_brace": "{" in text,
        }
        out |= {k: [(0, len(text), 1.0)] for k, hit in hits.items() if hit}
        out["line_count"] = [(0, len(text), len(lines))]
        return out

    return predict


@add_tagger("c4_v1")
def c4_v1():
    """Rules of a cleaned web crawl: lines without end, short lines, forbidden words, code."""
    return _c4(False, NAUGHTY)


@add_tagger("c4_v2")
def c4_v2():
    """The same on the lower-cased text, with "javascript" anywhere in it."""
    return _c4(True, NAUGHTY)


@add_tagger("gopher_v1")
def gopher_v1():
    """Shares of repeated n-grams and lines, lengths and symbols."""
    return lambda text, _: _gopher(text, "\n")


@add_tagger("gopher_v2")
def gopher_v2():
    """The same with runs of newlines as one."""
    return lambda text, _: _gopher(text, "\n+")


@add_tagger("uniseg_length_v1")
def uniseg_length():
    """Word segments of the stripped text, white space and all."""
    return lambda text, _: {"length": [(0, len(text), len(words_uax29(text.strip())))]}


def _uniseg(keep_blank: bool, with_doc: bool):
    def predict(text, _):
        parts = [(a, b, len(word_segments(body))) for a, b, body in split_paragraphs(text, keep_blank)]
        out = {"paragraph": parts, "negative_paragraph": [(a, b, -n) for a, b, n in parts]}
        if with_doc:
            total = sum(n for *_, n in parts)
            out |= {"document": [(0, len(text), total)], "negative_document": [(0, len(text), -total)]}
        return out

    return predict


@add_tagger("uniseg_length_paragraphs_v1")
def uniseg_paragraphs():
    """Words of each paragraph, and their negatives for filters that only have a least score."""
    return _uniseg(False, False)


@add_tagger("uniseg_length_paragraphs_with_empty_v1")
def uniseg_paragraphs_empty():
    """The same with blank paragraphs."""
    return _uniseg(True, False)


@add_tagger("uniseg_length_paragraphs_with_doc_length_v1")
def uniseg_paragraphs_doc():
    """The same with sums for the document."""
    return _uniseg(False, True)


def pretokens(text: str) -> list[str]:
    """Pieces of text before any merges: punctuation marks, single digits, and words with the blank before them."""
    return regex.findall(r"\p{P}|\p{N}| ?[^\s\p{P}\p{N}]+|\s+(?!\S)|\s", text)


@add_tagger("pretokenizer_v1")
def pretokenizer():
    """Number of pretokens of the document."""
    return lambda text, _: {"length": [(0, len(text), len(pretokens(text)))]}


@add_tagger("pretokenizer_with_paragraphs_v1")
def pretokenizer_paragraphs():
    """Numbers of pretokens of paragraphs, and their sum."""

    def predict(text, _):
        parts = [(a, b, len(pretokens(body))) for a, b, body in split_paragraphs(text)]
        return {"paragraph": parts, "document": [(0, len(text), sum(n for *_, n in parts))]}

    return predict


def add_tokenizer_tagger(name: str, path: str) -> None:
    """Registers a tagger that counts the tokens of a tokenizer file of the tokenizers library."""

    def make():
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(path).encode
        return lambda text, _: {"length": [(0, len(text), len(encode(text, add_special_tokens=False).ids))]}

    make.__doc__ = "Number of tokens by a tokenizer file."
    add_tagger(name)(make)


_SYMBOLS = regex.compile(r"(?:[[:punct:]\s\u2600-\u27bf\U0001f300-\U0001f64f\U0001f680-\U0001f6ff])+", regex.V1)


@add_tagger("not_alphanum_paragraph_v1")
def not_alphanum():
    """Paragraphs of punctuation, blanks and pictures alone."""

    def predict(text, _):
        found = [(a, b, 1) for a, b, body in split_paragraphs(text) if not re.search("[a-zA-Z0-9]", body) and _SYMBOLS.fullmatch(body)]
        return {"all_punct": found or [(0, len(text), 0)]}

    return predict


def pii_spans(text: str, window: int = 100) -> list[tuple[str, int, int]]:
    """(type, start, end): addresses, phone numbers and IP addresses, but for those whose context or form speaks against it."""
    out = []
    for kind, pattern in _PII.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "EMAIL_ADDRESS":
                name, host = text[a:b].split("@")[:2]
                ok = name.strip() != "(" and "." in host
            else:
                near = text[max(0, a - window) : b + window]
                ok = not any(v in near for v in _VETO)
            if ok:
                out.append((kind, a, b))
    return out


def _pii(with_count: bool, when_empty: float):
    def predict(text, _):
        found = pii_spans(text)
        out: Spans = {}
        for kind, a, b in found:
            out.setdefault(kind, []).append((a, b, 1.0))
        n = len(text.split())
        out["doc"] = [(0, len(text), len(found) / n if n else when_empty)]
        if with_count:
            out["doc_count"] = [(0, len(text), len(found))]
        return out

    return predict


@add_tagger("pii_regex_v1", defaults=_PII)
def pii_v1():
    """Personal data by expressions; the document's score is their number by word, 0 without a word."""
    return _pii(False, 0.0)


@add_tagger("pii_regex_v2", defaults=_PII)
def pii_v2():
    """The same with -1 for documents without a word."""
    return _pii(False, -1.0)


@add_tagger("pii_regex_with_counts_v2", defaults=_PII)
def pii_counts():
    """The same with their number."""
    return _pii(True, -1.0)


@add_tagger("pii_regex_with_counts_fast_v2", defaults=_PII)
def pii_fast():
    """Personal data paragraph by paragraph, with cheap tests first; number and share of characters for the document."""

    def predict(text, _):
        out: Spans = {}
        if text.count("?") <= 10_000:
            for start, _, body in split_paragraphs(text):
                if "@" in body or any(c.isdigit() for c in body):
                    for kind, a, b in pii_spans(body):
                        out.setdefault(kind, []).append((start + a, start + b, 1.0))
        its = [x for v in out.values() for x in v]
        out["doc_count"] = [(0, len(text), len(its))]
        out["doc_frac"] = [(0, len(text), sum(b - a for a, b, _ in its) / max(len(text), 1))]
        return out

    return predict


def _repetition_stats(spans: list, text: str) -> Spans:
    most = max((s for *_, s in spans), default=0.0)
    longest = max((b - a for a, b, _ in spans), default=0)
    share = sum(b - a for a, b, _ in spans) / len(text) if spans else 0.0
    whole = lambda v: [(0, len(text), v)]
    return {"repetition": spans, "doc_max_score_repetition": whole(most), "doc_max_length_repetition": whole(longest), "doc_frac_repetition": whole(share)}


def _char_repetitions(text: str) -> list[tuple[int, int, float]]:
    return [(m.start(), m.end(), m[0].count(m[1])) for m in repeated(text)]


@add_tagger("repetitions_v1")
def repetitions():
    """Groups of characters that occur four times or more in a row."""
    return lambda text, _: _repetition_stats(_char_repetitions(text), text)


@add_tagger("paragraph_repetitions_v1")
def paragraph_repetitions():
    """The same within paragraphs."""
    return lambda text, _: _repetition_stats([(at + a, at + b, s) for at, _, body in split_paragraphs(text, True) for a, b, s in _char_repetitions(body)], text)


def periodic_runs(ids: list[int], shortest: int = 1, longest: int = 13) -> list[tuple[int, int, int, int]]:
    """(start, end, period, times) of the maximal runs in which ids repeat with a period three times or more."""
    out, n = [], len(ids)
    for period in range(shortest, min(longest, n // 3) + 1):
        k = 0
        while k < n - period:
            if ids[k] != ids[k + period]:
                k += 1
                continue
            start = k
            while k < n - period and ids[k] == ids[k + period]:
                k += 1
            end = k + period
            # the run holds two equal rows of period-long pieces from its first whole row on, as pieces are aligned to the start
            first = -(-start // period) * period
            if (end - start) // period > 2 and first + 2 * period <= end:
                out.append((start, end, period, (end - start) // period))
    return out


def add_token_repetitions(name: str, path: str, by_paragraph: bool = False, no_overlap: bool = False, chunk: int = 100_000) -> None:
    """Registers a tagger of repeated token sequences of a tokenizer file, as the character taggers report them."""

    def make():
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(path).encode

        def spans(text: str) -> list:
            e = encode(text, add_special_tokens=False)
            found = [(e.offsets[a][0], e.offsets[b - 1][1], times) for a, b, _, times in periodic_runs(e.ids)]
            if no_overlap:
                kept, last = [], (-1, -1)
                for s in sorted(found, key=lambda s: (s[0], -s[1], -s[2])):
                    if not (s[0] >= last[0] and s[1] <= last[1]):
                        kept.append(s)
                        last = s[:2]
                found = kept
            return found

        def predict(text, _):
            if by_paragraph:
                parts = [(at - 1, " " + body) for at, _, body in split_paragraphs(text, True)]
            elif no_overlap:
                parts = [(i, text[i : i + chunk]) for i in range(0, len(text), chunk)]
            else:
                parts = [(0, text)]
            its = [(at + a, at + b, s) for at, body in parts for a, b, s in spans(body)]
            return {} if no_overlap and not its else _repetition_stats(its, text)

        return predict

    make.__doc__ = "Token sequences that occur three times or more in a row."
    add_tagger(name)(make)


_CC_HOST = "creativecommons.org/"
_CC_LINK = regex.compile(r"""<(?:a|meta)\s[^<>]*?(?:href|content)=["']?https?://creativecommons\.org/(?:licenses/(?P<kind>by(?:-nc)?(?:-nd)?(?:-sa)?)|(?P<kind>publicdomain/(?:zero|certification|mark)))(?:/(?P<version>\d+\.\d+))?(?:(?:/\w{2})?/(?:(?:deed|legalcode)\.)?(?P<lang>\w{2})\b)?[^<>]*>""", regex.IGNORECASE)
_CC_FAST = regex.compile(r"https?://creativecommons\.org/licenses/(?P<kind>(?:by(?:-nc)?(?:-sa|-nd)?)|publicdomain)[\"/ >]")


def _cc(pattern):
    def predict(text, fields):
        page = fields.get("html")
        if page is None:
            raise ValueError("the documents have no html")
        out: Spans = {}
        if _CC_HOST in page:
            for i, m in enumerate(pattern.finditer(page)):
                name = "_".join(["cc", m["kind"], *(m[k] for k in ("version", "lang") if k in pattern.groupindex and m[k])])
                out.setdefault(name, []).append((0, len(text), 0.5 + 0.5 / (i + 1)))
        return out

    return predict


@add_tagger("cc_re", fields=["html"])
def cc_re():
    """Creative Commons licences that a page's links or meta tags name; each further one counts less."""
    return _cc(_CC_LINK)


@add_tagger("cc_re_fast", fields=["html"])
def cc_re_fast():
    """The same from licence addresses anywhere in a page."""
    return _cc(_CC_FAST)


_SECRETS = {
    "SECRET_AWS_Access_Key": re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    "SECRET_Private_Key": re.compile(r"BEGIN (?:[A-Z]+ )*PRIVATE KEY"),
    "SECRET_JSON_Web_Token": re.compile(r"\beyJ[\w-]+\.eyJ[\w-]+\.[\w-]+"),
    "SECRET_Basic_Auth_Credentials": re.compile(r"://[^\s:/@]+:([^\s:/@]+)@"),
    "SECRET_Secret_Keyword": re.compile(r"(?i)(?:password|passwd|secret|api_?key|token)[\"']?\s*[:=]\s*[\"']?([^\s\"']{8,})"),
}


@add_tagger("code_secrets_v1", defaults=_SECRETS)
def code_secrets():
    """Keys and passwords by line; the document's score is their number by word."""

    def predict(text, _):
        out: Spans = {}
        for a, _, body in split_paragraphs(text):
            for kind, pattern in _SECRETS.items():
                for m in pattern.finditer(body):
                    out.setdefault(kind, []).append((a + m.start(m.lastindex or 0), a + m.end(m.lastindex or 0), 1.0))
        n = len(text.split())
        out["doc"] = [(0, len(text), sum(map(len, out.values())) / n if n else -1.0)]
        return out

    return predict


@add_tagger("code_copyright_comments_v1")
def code_copyright():
    """The first block comment if it holds a copyright, else the comment lines at the top."""

    def predict(text, _):
        m = re.search(r"/\*.*?\*/", text, re.DOTALL)
        if m and "copyright" in m[0].lower():
            return {"copyright_notice": [(m.start(), m.end(), 1.0)], "comment_block": []}
        end = 0
        for line in text.split("\n"):
            if line.strip() and not line.startswith(("//", "#", "--")):
                break
            end += len(line)
        return {"copyright_notice": [], "comment_block": [(0, end, 1.0)] if end else []}

    return predict


@add_tagger("code_redpajama_taggers_v1")
def code_redpajama():
    """Line lengths, share of letters and digits, letters by token."""

    def predict(text, _):
        lines = list(map(len, text.splitlines()))
        tokens = len(re.findall(r"\w+|[^\w\s]", text))
        whole = lambda v: [(0, len(text), v)]
        return {
            "max_line_length_doc": whole(max(lines, default=0)),
            "avg_line_length_doc": whole(sum(lines) / len(lines) if lines else 0),
            "alnum_prop_doc": whole(sum(map(str.isalnum, text)) / len(text) if text else 0),
            "alpha_token_prop_doc": whole(sum(map(str.isalpha, text)) / tokens if tokens else 0),
        }

    return predict


class _Visible(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style") and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def visible_text(page: str) -> str:
    """A page's text without its scripts and styles."""
    p = _Visible()
    p.feed(page)
    p.close()
    return "".join(p.parts)


_COMMENT = {"python": r"#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''", "java": r"//[^\n]*|/\*.*?\*/", "javascript": r"//[^\n]*|/\*.*?\*/"}


def _starcoder(only_known: bool):
    def predict(text, fields):
        lang = (fields.get("ext") or fields.get("language") or "").lower().lstrip(".")
        lang = {"py": "python", "js": "javascript"}.get(lang, lang)
        whole = lambda v: [(0, len(text), v)]
        if lang in _COMMENT:
            share = sum(len(m[0]) for m in re.finditer(_COMMENT[lang], text, re.DOTALL)) / len(text) if text else 0.0
        else:
            share = 0.5 if only_known else sum(len(x) for x in text.splitlines() if x.lstrip().startswith(("//", "#", "--"))) / max(len(text), 1)
        shown = len(visible_text(text)) / len(text) if lang == "html" and text else 1.0
        stars = fields.get("max_stars_count")
        return {"has_xml_template_doc": whole(float("<?xml version=" in text[:100])), "num_github_stars_doc": whole(float(stars) if stars else 0.0), "code_to_comment_ratio_doc": whole(share), "code_to_text_ratio_html_doc": whole(shown)}

    return predict


@add_tagger("code_starcoder_taggers_v1", fields=["ext", "language", "max_stars_count"])
def starcoder_v1():
    """XML at the top, stars, shares of comments and of visible text."""
    return _starcoder(False)


@add_tagger("code_starcoder_taggers_v2", fields=["ext", "language", "max_stars_count"])
def starcoder_v2():
    """The same with comments for the languages known alone."""
    return _starcoder(True)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, body) of parts that end in . ? or ! before white space, or at a newline."""
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\s][^\n]*?(?:[.?!]+(?=\s|$)|(?=\n|$))", text)]


def add_scorer_taggers(prefix: str, make_scorer, labels: list[str] | None = None) -> None:
    """Registers {prefix}_document, _paragraph and _sentence taggers of a scorer: a function without arguments that returns
    score(text) -> {label: probability}.  With ``labels`` every document has these types."""

    for level, cut in (("document", lambda t: [(0, len(t), t)]), ("paragraph", split_paragraphs), ("sentence", sentences)):

        def make(cut=cut):
            score = make_scorer()

            def predict(text, _):
                out: Spans = {}
                for a, b, body in cut(text):
                    for label, p in score(body).items():
                        out.setdefault(re.sub(r"\W", "_", label), []).append((a, b, p))
                return out

            return predict

        make.__doc__ = f"Labels of each {level} by a model."
        add_tagger(f"{prefix}_{level}", defaults=labels or ())(make)


def add_language_taggers(prefix: str, make_scorer, lang: str = "en") -> None:
    """Registers language taggers of a scorer score(text) -> {language: probability}: all languages, one and its complement, by
    document and by paragraph, and by paragraph with the document's mean weighted by length."""

    def pick(scores: dict[str, float]) -> dict[str, float]:
        p = scores.get(lang, 0.0)
        return {lang: p, f"not_{lang}": 1 - p}

    def build(cut, view, mean):
        def make():
            score = make_scorer()

            def predict(text, _):
                out: Spans = {}
                for a, b, body in cut(text):
                    for label, p in view(score(body)).items():
                        out.setdefault(label, []).append((a, b, p))
                if mean:
                    for label in (lang, f"not_{lang}"):
                        its = out.get(label, [])
                        out[f"doc_{label}"] = [(0, len(text), sum((b - a) * p for a, b, p in its) / len(text) if text else 0.0)]
                return out

            return predict

        make.__doc__ = "Languages by a model."
        return make

    whole = lambda t: [(0, len(t), t)]
    same = lambda s: s
    for name, cut, view, mean in (("doc", whole, same, False), ("en_doc", whole, pick, False), ("paragraph", split_paragraphs, same, False), ("en_paragraph", split_paragraphs, pick, False), ("en_paragraph_with_doc_score", split_paragraphs, pick, True)):
        add_tagger(f"{prefix}_{name.replace('en', lang, 1) if name.startswith('en') else name}")(build(cut, view, mean))


@add_tagger("code_composition")
def code_composition():
    """Runs of lines of code and of text: their bounds, and each kind's share, number and mean entropy."""

    def label(line: str) -> tuple[str, float]:
        marks = sum(c in "{}()[];=<>+*/\\|&_#" for c in line)
        p = 1 / (1 + math.exp(-(12 * marks / max(len(line), 1) - 1.2)))
        h = -sum(q * math.log(q) for q in (p, 1 - p) if q > 0)
        return ("code" if p > 0.5 else "text"), h

    def predict(text, _):
        out: Spans = {}
        runs, n = [], 0
        for a, b, body in split_paragraphs(text):
            kind, h = label(body)
            n += 1
            if runs and runs[-1][0] == kind:
                runs[-1] = (kind, runs[-1][1], b, runs[-1][3] + [h])
            else:
                runs.append((kind, a, b, [h]))
        for kind in sorted({r[0] for r in runs}):
            its = [r for r in runs if r[0] == kind]
            hs = [h for r in its for h in r[3]]
            out[f"{kind}_boundary"] = [(a, b, 1.0) for _, a, b, _ in its]
            out[f"{kind}_pct"] = [(0, len(text), len(hs) / n)]
            out[f"{kind}_count"] = [(0, len(text), len(its))]
            out[f"{kind}_mean_entropy"] = [(0, len(text), sum(hs) / len(hs))]
        return out

    return predict


#: Scorers of the published families of language taggers: makers of score(text) -> {language: probability}.  Without a model of one's own they all use
#: the built-in scorer.
LANGUAGE_SCORERS: dict[str, object] = {}
_FAMILIES = {
    "cld3": {"en_doc_v2": "en", "en_paragraph_v2": "en", "en_paragraph_with_doc_score_v2": "en"},
    "cld2": {"doc_v2": "all", "paragraph_v2": "all", "en_doc_v2": "en", "en_paragraph_v2": "en", "en_paragraph_with_doc_score_v2": "en"},
    "ft_lang_id": {"doc_v1": "all", "1e2": "some", "paragraph_v1": "all", "en_doc_v2": "en", "en_only_v2": "only", "en_paragraph_v2": "en", "en_paragraph_with_doc_score_v2": "en"},
    "langdetect": {"doc_v1": "all", "doc_en_v1": "en", "paragraph_v1": "all", "en_paragraph_v1": "en"},
    "lingua": {"doc_v1": "all", "1e2": "some", "doc_en_v1": "en", "en_only_v1": "only", "par_v1": "all", "en_par_v1": "en"},
}


def set_language_scorer(family: str, make) -> None:
    """Sets the maker of a family's scorer, for the taggers applied from now on."""
    if family not in _FAMILIES:
        raise ValueError(f"no such family: {family}")
    LANGUAGE_SCORERS[family] = make


def _language_predictor(view: str, by_paragraph: bool, with_doc: bool, make_scorer):
    def make():
        from ..functions.languages import languages

        score = make_scorer() if make_scorer else languages

        def predict(text, _):
            out: Spans = {}
            for a, b, body in split_paragraphs(text) if by_paragraph else [(0, len(text), text)]:
                found = score(body)
                if view == "all":
                    its = found
                elif view == "some":
                    its = {k: round(p, 2) for k, p in found.items() if p > 0.01}
                else:
                    p = found.get("en", 0.0)
                    its = {"en": p} if view == "only" else {"en": p, "not_en": 1.0 - p}
                for k, p in its.items():
                    out.setdefault(k, []).append((a, b, p))
            if with_doc:
                mean = sum((b - a) * p for a, b, p in out.get("en", [])) / len(text) if text else 0.0
                out["doc_en"], out["doc_not_en"] = [(0, len(text), mean)], [(0, len(text), 1 - mean if text else 0.0)]
            return out

        return predict

    return make


class _LanguageTagger:
    """Languages by the family's scorer: all, those over 0.01, or English and its complement, of the document or its paragraphs."""

    def __init__(self, family: str, kind: str, view: str):
        self.how = family, view, "par" in kind, "doc_score" in kind
        self.__doc__ = type(self).__doc__

    def _make(self):
        family, *how = self.how
        return _language_predictor(*how, LANGUAGE_SCORERS.get(family))

    def __reduce__(self):  # what goes to the workers is the maker with the scorer of the moment
        family, *how = self.how
        return _language_predictor, (*how, LANGUAGE_SCORERS.get(family))

    def __call__(self):
        return self._make()()


for _family, _kinds in _FAMILIES.items():
    for _kind, _view in _kinds.items():
        add_tagger(f"{_family}_{_kind}")(_LanguageTagger(_family, _kind, _view))


#: Models of the published classifier taggers: makers of score(text) -> {label: probability}.
CLASSIFIERS: dict[str, object] = {}
_CLASSIFIED = {"jigsaw_hatespeech_document_v2": "document", "jigsaw_hatespeech_sentence_v2": "sentence", "jigsaw_nsfw_document_v1": "document", "jigsaw_nsfw_sencence_v2": "sentence", "dclm-oh-eli5": "document"}


def set_classifier(name: str, make) -> None:
    """Sets the maker of a classifier tagger's scorer, for the taggers applied from now on; no such model comes with the package."""
    if name not in _CLASSIFIED:
        raise ValueError(f"no such classifier: {name}")
    CLASSIFIERS[name] = make


def _classifier(name: str, level: str, make_scorer):
    def make():
        if make_scorer is None:
            raise ValueError(f"set_classifier() gives no model for {name}")
        score = make_scorer()

        def predict(text, _):
            out: Spans = {}
            for a, b, body in sentences(text) if level == "sentence" else [(0, len(text), text)]:
                for label, p in score(body).items():
                    out.setdefault(re.sub(r"\W", "_", label), []).append((a, b, p))
            return out

        return predict

    return make


class _ClassifierTagger:
    """Labels of a document or its sentences by the model that set_classifier() gives."""

    def __init__(self, name: str, level: str):
        self.how, self.__doc__ = (name, level), type(self).__doc__

    def __reduce__(self):
        return _classifier, (*self.how, CLASSIFIERS.get(self.how[0]))

    def __call__(self):
        return _classifier(*self.how, CLASSIFIERS.get(self.how[0]))()


for _name, _level in _CLASSIFIED.items():
    add_tagger(_name)(_ClassifierTagger(_name, _level))
