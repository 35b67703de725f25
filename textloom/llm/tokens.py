"""Token counts of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import importlib.util
import os

import pyarrow as pa

#: The pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Path of the rank file: TEXTLOOM_VOCABULARY, else that of the installed package of public tokenizers."""
    if path := os.environ.get("TEXTLOOM_VOCABULARY"):
        return path
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


def read_vocabulary(path: str | None = None) -> bytes:
    """The rank file's bytes, read on the driver; under 1 MB, so that tasks carry it and executors need no such file."""
    with open(path or default_vocabulary(), "rb") as f:
        return f.read()


class TokenCounter:
    """Exact token counts, several times as fast as encoding.

    The pattern always begins a new piece at a blank that follows something and precedes a non-blank, so the count of a text is
    the sum over its blank-separated words, each with its blank before it.  Counts of words are kept, in a table of bounded
    size; the words that aren't there are encoded together.  Texts with runs of blanks are encoded as they are.
    """

    def __init__(self, vocabulary: bytes, kept: int = 300_000):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self._encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._kept, self._most = {}, kept

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text:
            return len(self._encode(text))
        first, *rest = text.split(" ")
        total = len(self._encode(first))
        kept = self._kept
        found = [kept.get(w, -1) for w in rest]
        known = sum(found)
        if missing := found.count(-1):
            known += missing
            if len(kept) < self._most:
                encode = self._encode
                for w, n in zip(rest, found):
                    if n < 0:
                        n = kept.get(w)
                        if n is None:
                            n = kept[w] = len(encode(" " + w))
                        known += n
            else:
                known += len(self._encode("".join([" " + w for w, n in zip(rest, found) if n < 0])))
        return total + known

    def counts(self, texts: pa.Array) -> pa.Array:
        return pa.array([self.count(t) for t in texts.to_pylist()], pa.int64())


_COUNTERS: dict[int, TokenCounter] = {}


def counter(vocabulary: bytes) -> TokenCounter:
    """This process's counter for the vocabulary."""
    key = hash(vocabulary)
    if key not in _COUNTERS:
        _COUNTERS[key] = TokenCounter(vocabulary)
    return _COUNTERS[key]
