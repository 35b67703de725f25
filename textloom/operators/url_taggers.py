"""Documents whose address is on a list: native joins against the list, and a tagger for small lists."""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import add_tagger

_HOST = re.compile(r"(?:[a-z0-9_-]+\.?){2,}|localhost|localdomain")
_LOCAL = ("127.0.0.1", "0.0.0.0", "::1")


def clean_link(url: Column) -> Column:
    """Host, port and path in lower case, without scheme, user, query, fragment and slashes at the end; null for a blank one."""
    bare = F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"^[^/@]*@", "")
    return F.when(F.trim(url) != "", F.lower(F.regexp_replace(bare, r"/+$", "")))


def clean_host(url: Column) -> Column:
    """The link's host without leading characters of "www."."""
    return F.regexp_replace(F.regexp_extract(clean_link(url), r"^([^/:]*)", 1), r"^[w.]+", "")


def parse_line(line: str, keep_local: bool = True) -> list[str]:
    """Addresses on a line of a block list: bare, in the form of a hosts file, or of an ad filter; none on comments.

    A host that the line maps to an address is given with the address.  ``keep_local`` keeps addresses of the machine itself, as
    lists compiled elsewhere do.  Other lines raise ValueError.
    """
    line = line.strip().lower()
    if not line or line[0] in "#;!":
        return []
    parts = line.split()
    if len(parts) >= 2 and re.fullmatch(r"[0-9a-f.:]+", parts[0]) and (m := _HOST.match(parts[1])):
        ipaddress.ip_address(parts[0])
        own = [] if not keep_local and parts[0] in _LOCAL else [parts[0]]
        return own + ([] if m[0] in ("localhost", "localdomain") else [m[0].rstrip("/")])
    if line.startswith("|") and (m := re.match(r"\|+((?:[a-z0-9_-]+\.?){2,})\^", line)):
        return [m[1]]
    if _HOST.match(line) or re.match(r"https?://", line):
        bare = re.sub(r"^https?://", "", line)
        return [re.sub(r"[?#].*$", "", bare).rstrip("/")]
    raise ValueError(f"not a line of a block list: {line}")


def parse_list(lines: DataFrame) -> DataFrame:
    """(address) of the lines (value) of block lists, without those that can't be read."""

    def parse(values: pa.Array) -> pa.Array:
        return pa.array([_readable(v or "") for v in values.to_pylist()], pa.list_(pa.string()))

    parse.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return lines.select(F.explode(F.arrow_udf(parse, "array<string>")("value")).alias("address")).distinct()


def _readable(line: str) -> list[str]:
    try:
        return parse_line(line)
    except ValueError:
        return []


def flag_listed(docs: DataFrame, addresses: DataFrame, by: str = "link", url_col: str = "url", flag: str = "listed") -> DataFrame:
    """docs with whether their address is on the list, by whole link or by host (with or without "www.").

    A left join on the cleaned address; Spark broadcasts the list if it is small.  Null addresses aren't listed.
    """
    key = clean_link(docs[url_col]) if by == "link" else clean_host(docs[url_col])
    listed = addresses.select((F.col("address") if by == "link" else F.regexp_replace(F.regexp_extract("address", r"^([^/:]*)", 1), r"^[w.]+", "")).alias("_address")).where("_address <> ''").distinct().withColumn("_hit", F.lit(True))
    joined = docs.withColumn("_key", key).join(listed, F.col("_key") == F.col("_address"), "left")
    return joined.withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_key", "_address", "_hit")


def _is_listed(listed: set[str], by: str):
    """predict(text, fields) of a list of addresses."""

    def predict(text, fields):
        url = (fields.get("url") or "").strip().lower()
        bare = re.sub(r"^[^/@]*@", "", re.sub(r"[?#].*$", "", re.sub(r"^(?:[a-z][a-z0-9+.-]*:)?//", "", url))).rstrip("/")
        if by == "link":
            hit = bool(bare) and bare in listed
        else:
            host = re.match(r"[^/:]*", bare)[0].lstrip("w.")
            tried = [host, "www." + host] if host else []
            if by == "base":
                tried += [".".join(x.split(".")[-2:]) for x in tried if x.count(".") > 2]
            hit = any(x in listed for x in tried)
        return {"url": [(0, len(text), 1.0)]} if hit else {}

    return predict


def add_list_tagger(name: str, lines: Iterable[str], by: str = "link") -> None:
    """Registers a tagger: a span of the whole text if the document's url is on the list."""
    listed = {x for line in lines for x in _readable(line)}
    if not listed:
        raise ValueError(f"the list of {name} is empty")

    def make():
        return _is_listed(listed, by)

    make.__doc__ = "Documents whose address is on a list."
    add_tagger(name, defaults=["url"], fields=["url"])(make)


class AdFilter:
    """Ad-filter rules: plain parts with * and ^, || for a host and its subdomains, | for an end, @@ for exceptions.

    Rules for a host are looked up by the hosts above that of a url, others by a word that a url must hold, so a url meets few of them.
    """

    def __init__(self, rules: Iterable[str]):
        self.block, self.allow = ({}, {}), ({}, {})
        for rule in rules:
            rule = rule.strip()
            if not rule or rule[0] in "![" or "##" in rule or "#@#" in rule:
                continue
            by_host, by_word = self.allow if rule.startswith("@@") else self.block
            rule = rule.removeprefix("@@").split("$")[0].lower()
            pattern = self._compile(rule)
            if m := re.match(r"\|\|([a-z0-9_-]+(?:\.[a-z0-9_-]+)+)(?=[/^:]|$)", rule):
                by_host.setdefault(m[1], []).append(pattern)
            else:
                # a run of letters and digits that the rule has whole, the longest: none next to a wildcard or to an end without anchor
                inner = re.findall(r"(?<![a-z0-9*])[a-z0-9]{2,}(?![a-z0-9*])", rule.strip("|") if rule.startswith("|") else "*" + rule + "*")
                by_word.setdefault(max(inner, key=len, default=""), []).append(pattern)

    @staticmethod
    def _compile(rule: str) -> re.Pattern:
        head = ""
        if rule.startswith("||"):
            head, rule = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", rule[2:]
        elif rule.startswith("|"):
            head, rule = "^", rule[1:]
        tail = ""
        if rule.endswith("|"):
            tail, rule = "$", rule[:-1]
        body = "".join({"*": ".*", "^": r"(?:[^\w.%-]|$)"}.get(c, re.escape(c)) for c in rule)
        return re.compile(head + body + tail, re.IGNORECASE)

    @staticmethod
    def _hits(rules: tuple[dict, dict], url: str) -> bool:
        by_host, by_word = rules
        lower = url.lower()
        if by_host and (m := re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", lower)):
            labels = m[1].split(".")
            for k in range(len(labels)):
                if any(p.search(url) for p in by_host.get(".".join(labels[k:]), ())):
                    return True
        words = {"", *re.findall(r"[a-z0-9]{2,}", lower)}
        return any(p.search(url) for w in words for p in by_word.get(w, ()))

    def blocks(self, url: str) -> bool:
        return self._hits(self.block, url) and not self._hits(self.allow, url)


def add_ad_filter_tagger(name: str, rules: Iterable[str]) -> None:
    """Registers a tagger: a span of the whole text if ad-filter rules block the document's url."""
    rules = list(rules)

    def make():
        its = AdFilter(rules)
        return lambda text, fields: {"url": [(0, len(text), 1.0)]} if fields.get("url") and its.blocks(fields["url"]) else {}

    make.__doc__ = "Documents whose address ad-filter rules block."
    add_tagger(name, defaults=["url"], fields=["url"])(make)


#: Published block and allow lists by their taggers' names, and how an address is looked up: whole, by host, by host and its base, by ad-filter rules.
PUBLISHED = {
    "domain_blocklist_utp_v1": "host", "link_blocklist_phishing_v1": "link", "domain_blocklist_phishing_v1": "host",
    **dict.fromkeys(["oisd_small_abp_v1", "oisd_big_abp_v1", "oisd_nsfw_abp_v1", "brave_core_abp_v1", "brave_nsfw_abp_v1"], "ads"),
    **{f"blocklist_project_{x}_v1": "host" for x in ("nsfw", "social", "crime", "vice", "ads")},
    **{f"blocklist_firebog_{x}_v1": "host" for x in ("ads", "crypto", "malicious", "nsfw", "social", "suspicious", "trackers")},
    **{f"blocklist_hosts_{x}_v1": "host" for x in ("adware_malware", "fakenews", "gambling", "porn", "social")},
    "allowlist_wikidata_v1": "base", "allowlist_wikidata_cleaned_v1": "base",
}
_PATHS: dict[str, list[str]] = {}
#: What the description of an entry of the cleaned list may not hold.
_UNCLEAN = re.compile(r"sex|adult|satire|gossip|tabloid|tracker|dating|porn|betting|casino|gambling|celebrity|joke|humor|comedy", re.IGNORECASE)


def set_lists(paths: dict[str, list[str]]) -> None:
    """Files of the lists of published taggers, by tagger; the workers must see them.  Call it before taggers are applied."""
    if unknown := sorted(set(paths) - set(PUBLISHED)):
        raise ValueError(f"no such lists: {', '.join(unknown)}")
    _PATHS.update({k: list(v) for k, v in paths.items()})


def _lines(name: str, paths: list[str]) -> Iterable[str]:
    import gzip

    for path in paths:
        with (gzip.open if path.endswith(".gz") else open)(path, "rt", errors="replace") as f:
            if path.endswith(".json"):
                for row in json.load(f):
                    if not (name.endswith("_cleaned_v1") and _UNCLEAN.search(f"{row.get('description') or ''}")):
                        yield re.sub(r"^[^/@]*@", "", str(row.get("url") or ""))
            else:
                yield from f


def _publish(name: str, by: str) -> None:
    class Make:
        """Documents whose address is on the published list of that name, read from the files that set_lists() gives."""

        def __reduce__(self):
            return _made, (name, by, _PATHS.get(name))

        def __call__(self):
            return _made(name, by, _PATHS.get(name))()

    make = Make()
    make.__doc__ = Make.__doc__
    add_tagger(name, defaults=["url"], fields=["url"])(make)


def _made(name: str, by: str, paths: list[str] | None):
    def make():
        if not paths:
            raise ValueError(f"set_lists() gives no files for {name}")
        if by == "ads":
            its = AdFilter(_lines(name, paths))
            return lambda text, fields: {"url": [(0, len(text), 1.0)]} if fields.get("url") and its.blocks(fields["url"]) else {}
        listed = {x for line in _lines(name, paths) for x in _readable(line)}
        if by != "link":
            listed = {re.match(r"[^/:]*", x)[0].lstrip("w.") for x in listed} - {""}
        return _is_listed(listed, by)

    return make


for _name, _by in PUBLISHED.items():
    _publish(_name, _by)
