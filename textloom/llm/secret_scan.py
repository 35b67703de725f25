"""Secret detection: keyword automaton, anchored expressions near its hits, checksums where a format embeds one."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Least entropy in bits a character of a value that only its name makes a secret.
LEAST_ENTROPY = 2.5
SCHEMA = "doc_id long, rule string, start long, stop long, checksum string, shown string, digest string"
#: Bytes of UTF-8 that continue a character.
_CONTINUE = bytes(range(0x80, 0xC0))
_ARROW = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("checksum", pa.string()), ("shown", pa.string()), ("digest", pa.string())])


def _crc62(secret: str) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    body, check = secret[-36:-6], secret[-6:]
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.rjust(6, "0") == check


def _jwt(secret: str) -> bool:
    """The first part is base64 of a JSON object that names an algorithm."""
    head = secret.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def _account(secret: str) -> bool:
    """The characters after the prefix hold a 12-digit account number in base 32."""
    raw = int.from_bytes(base64.b32decode(secret[4:20])[:6], "big")
    return (raw & 0x7FFFFFFFFF80) >> 7 < 10**12


def _key64(secret: str) -> bool:
    try:
        return len(base64.b64decode(secret, validate=True)) == 64
    except (ValueError, binascii.Error):
        return False


def _bech32(secret: str) -> bool:
    """The last six characters are the checksum that BIP 173 defines."""
    secret = secret.lower()
    head, _, data = secret.rpartition("1")
    letters = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
    values = [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + [letters.find(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            if top >> i & 1:
                check ^= g
    return check == 1


class Rule:
    """Keywords in lower case, the expression that must match where one of them begins, and what a match must still pass."""

    def __init__(self, name: str, keywords: list[str], pattern: str, check: Callable[[str], bool] | None = None, entropy: bool = False):
        self.name, self.keywords, self.check, self.entropy = name, keywords, check, entropy
        self.pattern = re.compile(pattern, re.ASCII)


class Assignment(Rule):
    """A name with one of the keywords in it, a sign and a value, which ``names`` and three expressions make up.

    A value may hold names with values of their own, which end where it ends.  ``find`` has what ``pattern`` matches at the
    keywords, but reads a name's rest once for all keywords in it, and a value once for all that end with it.
    """

    REST = r"[\w.-]*+"
    SIGN = r"[\"']?[ \t]*+(?:=>|:=|=|:)[ \t]*+(?P<q>[\"'`]?)"
    VALUE = r"[^\s\"'`,;]"

    def __init__(self, name: str, keywords: list[str], names: str):
        super().__init__(name, keywords, names + self.REST + self.SIGN + f"(?P<s>{self.VALUE}{{8,}}+)(?P=q)", entropy=True)
        self.rest, self.value = re.compile(self.REST, re.ASCII), re.compile(self.VALUE + "*+", re.ASCII)
        self.sign = re.compile(f"{self.SIGN}(?={self.VALUE}{{8}})", re.ASCII)

    def find(self, flat: str, places: list[int]) -> Iterator[tuple[int, int]]:
        """Where values begin and end, of the names with keywords at ``places``, which are ordered by the keywords' ends."""
        starts: dict[int, list[int]] = {}
        rest = stop = 0
        for at in places:
            if at < rest:  # a keyword in the name before
                continue
            rest = self.rest.match(flat, at).end()
            if m := self.sign.match(flat, rest):
                if m.end() >= stop:
                    stop = self.value.match(flat, m.end()).end()
                if flat.startswith(m["q"], stop):
                    starts.setdefault(stop, []).append(m.end())
        for stop, its in starts.items():
            counts, read = Counter(), stop
            for start in reversed(its):
                counts.update(flat[start:read])
                read = start
                if random_enough(counts):
                    yield start, stop


_EDGE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_NAMES = ["password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key", "private_key", "private-key"]
_NAME = r"(?i:password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]key)"

#: Names and secrets are taken to their ends, whatever their length; only what a provider issues in one length has that length here.
#: Each expression begins with the rule's keyword; the group ``s`` is the secret.
RULES = [
    Rule("aws-access-key", ["akia", "asia"], _EDGE + r"(?P<s>(?:AKIA|ASIA)[A-Z2-7]{16})" + _END, _account),
    Rule("github-token", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], _EDGE + r"(?P<s>gh[pousr]_[A-Za-z0-9]{36})" + _END, _crc62),
    Rule("npm-token", ["npm_"], _EDGE + r"(?P<s>npm_[A-Za-z0-9]{36})" + _END, _crc62),
    Rule("gitlab-token", ["glpat-"], _EDGE + r"(?P<s>glpat-[A-Za-z0-9_-]{20})" + _END),
    Rule("slack-token", ["xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"], _EDGE + r"(?P<s>xox[abprs]-[0-9A-Za-z-]{10,}+)" + _END),
    Rule("stripe-key", ["sk_live_", "rk_live_"], _EDGE + r"(?P<s>[sr]k_live_[0-9A-Za-z]{16,}+)" + _END),
    Rule("google-key", ["aiza"], _EDGE + r"(?P<s>AIza[0-9A-Za-z_-]{35})" + _END),
    Rule("json-web-token", ["eyj"], _EDGE + r"(?P<s>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{8,}+)", _jwt),
    Rule("azure-key", ["accountkey="], r"(?i:AccountKey)=(?P<s>[A-Za-z0-9+/]{86}==)", _key64),
    Rule("private-key", ["-----begin "], r"(?P<s>-----BEGIN (?:[A-Z]++ )*?PRIVATE KEY(?: BLOCK)?-----)"),
    Rule("github-fine-token", ["github_pat_"], _EDGE + r"(?P<s>github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59})" + _END),
    Rule("pypi-token", ["pypi-"], _EDGE + r"(?P<s>pypi-[A-Za-z0-9_-]{16,}+)"),
    Rule("sendgrid-key", ["sg."], _EDGE + r"(?P<s>SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+)" + _END),
    Rule("slack-webhook", ["hooks.slack.com/"], r"(?P<s>hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9_/]{20,}+)"),
    Rule("slack-app-token", ["xapp-"], _EDGE + r"(?P<s>xapp-[0-9A-Za-z-]{20,}+)" + _END),
    Rule("discord-webhook", ["discord.com/api/webhooks/", "discordapp.com/api/webhooks/"], r"(?P<s>discord(?:app)?\.com/api/webhooks/[0-9]{15,20}/[A-Za-z0-9_-]{60,}+)"),
    Rule("openai-key", ["sk-"], _EDGE + r"(?P<s>sk-[A-Za-z0-9_-]{32,}+)" + _END),
    Rule("hugging-face-token", ["hf_"], _EDGE + r"(?P<s>hf_[A-Za-z]{34})" + _END),
    Rule("google-oauth", ["ya29.", "gocspx-"], _EDGE + r"(?P<s>ya29\.[0-9A-Za-z_-]{20,}+|GOCSPX-[0-9A-Za-z_-]{28}(?![0-9A-Za-z_-]))"),
    Rule("digitalocean-token", ["dop_v1_", "doo_v1_", "dor_v1_"], _EDGE + r"(?P<s>do[opr]_v1_[0-9a-f]{64})" + _END),
    Rule("shopify-token", ["shpat_", "shpca_", "shppa_", "shpss_"], _EDGE + r"(?P<s>shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32})" + _END),
    Rule("square-token", ["sq0atp-", "sq0csp-"], _EDGE + r"(?P<s>sq0(?:atp|csp)-[0-9A-Za-z_-]{22,}+)"),
    Rule("docker-token", ["dckr_pat_"], _EDGE + r"(?P<s>dckr_pat_[0-9A-Za-z_-]{20,}+)"),
    Rule("databricks-token", ["dapi"], _EDGE + r"(?P<s>dapi[0-9a-f]{32})" + _END),
    Rule("mailgun-key", ["key-"], _EDGE + r"(?P<s>key-[0-9a-f]{32})" + _END),
    Rule("age-key", ["age-secret-key-1"], _EDGE + r"(?P<s>AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58})" + _END, _bech32),
    Rule("url-password", ["://"], r"://[^\s:/?#@\"'<>]*+:(?P<s>[^\s/?#@\"'<>]{3,}+)@[A-Za-z0-9\[]"),
    Assignment("assignment", _NAMES, _NAME),
]


def entropy(text: str | Counter) -> float:
    """Bits a character, of a text or its characters' counts in whatever order."""
    counts = Counter(text)
    size = counts.total()
    return -math.fsum(n / size * math.log2(n / size) for n in counts.values())


def random_enough(counts: Counter) -> bool:
    """Whether a value of these characters holds digits and letters and enough entropy."""
    return any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts) and entropy(counts) >= LEAST_ENTROPY


def accept(rule: Rule, secret: str) -> str | None:
    """The checksum's verdict, "none" for formats without, or None if the match is no secret."""
    if rule.entropy and not random_enough(Counter(secret)):
        return None
    if rule.check is None:
        return "none"
    return "passed" if rule.check(secret) else "failed"


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[Rule]] = {}
        for rule in rules:
            for word in rule.keywords:
                by.setdefault(word, []).append(rule)
        for word, its in by.items():
            self.automaton.add_word(word, (len(word), its))
        if by:
            self.automaton.make_automaton()
        self.some = bool(by)

    def scan(self, text: str) -> list[tuple[str, int, int, str, str, str]]:
        """(rule, start, stop, checksum, shown, digest) by place; start and stop count characters."""
        if not self.some:
            return []
        raw = text.encode("utf-8", "surrogatepass")
        flat, found, named = None, {}, {}
        for last, (size, rules) in self.automaton.iter(raw.lower().decode("latin-1")):  # bytes.lower() keeps every offset
            if flat is None:
                flat = raw.decode("latin-1")
            at = last - size + 1
            for rule in rules:
                if isinstance(rule, Assignment):
                    named.setdefault(rule, []).append(at)
                    continue
                m = rule.pattern.match(flat, at)
                if m and (verdict := accept(rule, m["s"])):
                    found[(*m.span("s"), rule.name)] = verdict
        for rule, places in named.items():
            found |= {(*span, rule.name): "none" for span in rule.find(flat, places)}
        number, read, n = {}, 0, 0  # of characters before each place
        for at in sorted({at for key in found for at in key[:2]}):
            n += len(raw[read:at].translate(None, _CONTINUE)) if len(raw) != len(text) else at - read
            read = at
            number[at] = n
        out, view = [], memoryview(raw)
        for (a, b, name), verdict in sorted(found.items()):
            shown = flat[a : min(a + 4, b)] + "*" * (min(b - a, 20) - 4)
            out.append((name, number[a], number[b], verdict, shown, hashlib.sha256(view[a:b]).hexdigest()[:16]))
        return out


def secret_scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, start, stop, checksum, shown, digest) of every secret in the texts.

    One pass of an automaton over the whole text finds the keywords, whatever their case.  A rule's expression is matched at
    its keyword and nowhere else.  ``checksum`` is "passed" or "failed" for formats that embed a checksum or a structure that can be
    decoded, else "none"; a match whose checksum fails is reported as such and is most likely no live secret.  A
    name with a value assigned counts if the value holds letters and digits and is random enough.  Secrets aren't
    repeated in the result: ``shown`` is their beginning, ``digest`` the start of their SHA-256.

    Edge cases: null and empty texts hold nothing.  A secret that two keywords of a rule lead to is reported once, each
    place of a repeated secret by itself, one that two rules match once for each.  Assignments inside an assigned value are
    reported like any other, however long it is; as each digest is of a whole value, those within one another take time by the
    sum of their lengths.  Rows with null or repeated ids are scanned like any other.  Texts are read whole, however long.  start and stop
    count characters, from 0.  No rows give no rows.  Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = scanner.scan(text)
                at += [i] * len(hits)
                found += hits
            rest = zip(*found) if found else ([],) * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, f.type) for x, f in zip(rest, list(_ARROW)[1:]))], schema=_ARROW)

    return docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text")).where(F.col("text") != "").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret found in the documents."""
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
