"""URL filters: host rules and pattern rules indexed by their rarest literal token.

Two kinds of rule, both turned into a regular expression over a normalised URL and both found
through the same index:

* host rules (``example.com/en/``): fit a host and its subdomains where the path starts with the
  rule's; the longest wins, and any of them goes before pattern rules;
* pattern rules on the whole URL, with ``*`` for anything, ``||`` for the start of a host label,
  ``^`` for a separator or the end, ``|`` for the start or end of the URL; ``allow`` ones go before
  ``block`` ones.

A token is a maximal run of ``[a-z0-9%]``.  Every rule is filed under that token of its own which is
rarest in the table's URLs and which must appear in full in any URL that fits; a rule without such
a token is tested on every URL.  A URL's distinct tokens fetch the rules filed under them, and only
those run their expression.

The rules are configuration: a list of at most ``MAX_RULES`` that travels in the plan as one folded
constant, hashed into buckets so that a token's lookup is one array access.  So there is no
shuffle, no join and no Python on the rows' path, and a hot host or URL costs nothing extra.
"""

from __future__ import annotations

import json
import re
import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: more rules than this don't belong in a plan
MAX_RULES = 20_000
_TOKEN = re.compile(r"[a-z0-9%]+")


class Rule(NamedTuple):
    verdict: str
    text: str
    host_rule: bool


class Compiled(NamedTuple):
    rule: Rule
    regex: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, text: str) -> Rule:
    return Rule(verdict, text, True)


def pattern(verdict: str, text: str) -> Rule:
    return Rule(verdict, text, False)


def _quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def _inner_tokens(text: str, open_start: bool, open_end: bool) -> list[str]:
    """Tokens of a literal that a URL must hold in full; one at an open end may go on there."""
    out = []
    for m in _TOKEN.finditer(text):
        if not (open_start and m.start() == 0) and not (open_end and m.end() == len(text)):
            out.append(m.group())
    return out


def compile_rule(rule: Rule) -> Compiled:
    """Java regular expression over ``host + path`` (host rules) or the lower-cased URL, and usable tokens."""
    if rule.host_rule:
        host, slash, path = rule.text.partition("/")
        low = (slash + path).lower()
        tokens = _inner_tokens(host.lower(), False, False) + _inner_tokens(low, False, True)
        return Compiled(rule, rf"^(?:[^/]*\.)?{_quote(host.lower())}{_quote(slash + path)}", tuple(tokens))
    text = rule.text.lower()
    start = "^" if text.startswith("|") and not text.startswith("||") else ""
    label = text.startswith("||")
    end = "$" if text.endswith("|") and len(text) > 1 else ""
    core = text.lstrip("|") if start or label else text
    core = core[:-1] if end else core
    regex, tokens = "", []
    parts = re.split(r"([*^])", core)
    for i, part in enumerate(parts):
        if part == "*":
            regex += ".*"
        elif part == "^":
            regex += r"(?:[^a-z0-9%_.\-]|$)"
        elif part:
            before = parts[i - 1] if i else ("" if start or label else "*")
            after = parts[i + 1] if i + 1 < len(parts) else ("" if end else "*")
            tokens += _inner_tokens(part, before == "*", after == "*")
            regex += _quote(part)
    head = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*\.)?" if label else start
    return Compiled(rule, "(?s)" + head + regex + end, tuple(tokens))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL."""
    return F.array_distinct(F.regexp_extract_all(_lower(url), F.lit(r"[a-z0-9%]+"), F.lit(0)))


def token_counts(urls: DataFrame, url_col: str, tokens: list[str]) -> dict[str, int]:
    """In how many rows each of the rules' tokens appears (one row per token comes to the driver)."""
    known = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in tokens], "known string"))
    seen = urls.select(F.explode(tokens_of(F.col(url_col).cast("string"))).alias("token"))
    return {r["token"]: r["n"] for r in seen.join(known, F.col("token") == F.col("known"))
            .groupBy("token").agg(F.count("*").alias("n")).collect()}


_ENTRY = "token:string,regex:string,host_rule:boolean,rank:int,verdict:string,text:string"


def _index(rules: list[Compiled], counts: dict[str, int]) -> tuple[Column, int]:
    """Folded constant: buckets of entries by the hash of a token; bucket 0 has the rules without one."""
    size = max(1, 2 * len(rules))
    buckets: list[list[dict]] = [[] for _ in range(size + 1)]
    # rank: host rules by length, then pattern rules, allow before block
    order = sorted(rules, key=lambda c: (not c.rule.host_rule, -len(c.rule.text) if c.rule.host_rule else 0,
                                         c.rule.verdict, c.rule.text))
    for rank, c in enumerate(order):
        token = min(c.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
        entry = {"token": token, "regex": c.regex, "host_rule": c.rule.host_rule, "rank": rank,
                 "verdict": c.rule.verdict, "text": c.rule.text}
        buckets[0 if token is None else 1 + zlib.crc32(token.encode()) % size].append(entry)
    schema = "array<array<struct<" + _ENTRY + ">>>"
    return F.from_json(F.lit(json.dumps(buckets)), F.lit(schema)), size


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict, matched, candidates`` to the rows (in place of columns so named).

    ``rule`` is the host rule that decided, else null; ``matched`` the rule of either kind that did;
    ``candidates`` the number of rules whose expression ran.  A null URL, or one without ``://``, has an empty host and
    path; it fits no rule by host, and patterns only where its text does.  Ties between equal rules
    go to the one that sorts first.  Repeated rows are judged alike; an empty table stays empty.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    compiled = [compile_rule(r) for r in dict.fromkeys(rules)]
    counts = token_counts(pages, url_col, sorted({t for c in compiled for t in c.tokens})) if compiled else {}
    index, size = _index(compiled, counts)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path, low = host_of(url), path_of(url), _lower(url)
    place = F.concat(host, path)

    def fetched(t: Column) -> Column:
        bucket = F.element_at(index, (F.lit(2) + F.crc32(t) % F.lit(size)).cast("int"))
        return F.filter(bucket, lambda r: r["token"] == t)

    candidates = F.concat(F.element_at(index, 1), F.flatten(F.transform(tokens_of(url), fetched)))
    fits = F.filter(candidates, lambda r: F.when(r["host_rule"], F.regexp(place, r["regex"])).otherwise(F.regexp(low, r["regex"])))
    best = F.element_at(F.array_sort(F.transform(fits, lambda r: F.struct(r["rank"].alias("rank"), r["host_rule"].alias("host_rule"),
                                                                          r["verdict"].alias("verdict"), r["text"].alias("text")))), 1)
    made = {"host", "path", "rule", "verdict", "matched", "candidates"}
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in made]
    out = pages.select(*keep, host.alias("host"), path.alias("path"),
                       F.when(F.size(fits) > 0, best).alias("best"), F.size(candidates).alias("candidates"))
    rest = [F.col(f"`{c}`") for c in out.columns if c not in ("best", "candidates")]
    return out.select(*rest, F.when(F.col("best.host_rule"), F.col("best.text")).alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.text").alias("matched"), "candidates")


#: rules of the registered query: host rules first, then patterns for pages of no host rule
DEFAULT_RULES = [
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
    pattern("block", "||spam-farm.example.org^"),
    pattern("block", "||spam-farm.example.net^"),
    pattern("block", "/casino/"),
    pattern("block", "/poker^"),
    pattern("block", "://ads.*/banner^"),
    pattern("block", "*.exe|"),
    pattern("block", "^sessionid="),
    pattern("block", "/wp-login.php"),
    pattern("allow", "/casino/history^"),
]
