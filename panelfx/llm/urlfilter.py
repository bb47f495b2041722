"""URL filters: pattern rules found through their rarest literal token.

A rule is either a place (a host with all its subdomains, and the beginning of a path) or a pattern in the usual filter
notation: ``*`` stands for anything, ``^`` for a separator or the end, ``||`` for the start of the host or of one of its
labels, ``|`` for the start or end of the url. Both become regular expressions. The literal tokens that every fitting
url must contain whole are read off the rule, and the rule is filed under the one that the fewest urls contain. A url
fetches the rules filed under its own tokens, and only these expressions run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed, per_row

ALLOW, BLOCK = "allow", "block"
_TOKEN = "[a-z0-9]+"
#: Rules travel with the tasks; beyond this many characters they are refused.
MOST = 64 << 20


@dataclass(frozen=True)
class Rule:
    """``place`` ("example.org/es/") or ``pattern`` ("||ads-*^"), and what it decides."""
    verdict: str
    place: str | None = None
    pattern: str | None = None

    def regex(self) -> str:
        """An expression for ``host + path + rest`` after the scheme; places match the path's case, patterns any."""
        if self.place is not None:
            host, slash, path = self.place.partition("/")
            return rf"(?:[^/?#]*\.)?{re.escape(host.lower())}(?=[/?#]|\Z){re.escape(slash + path)}"
        body, head, tail = self.pattern or "", "", ""
        if body.startswith("||"):
            head, body = r"(?:[^/?#]*\.)?", body[2:]
        elif body.startswith("|"):
            body = body[1:]
        else:
            head = ".*?"
        if body.endswith("|"):
            tail, body = r"\Z", body[:-1]
        parts = {"*": ".*?", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
        return "(?is:" + head + "".join(parts.get(c) or re.escape(c) for c in body) + tail + ")"

    def tokens(self) -> list[str]:
        """Literal tokens that stand whole in every fitting url."""
        if self.place is not None:
            host, slash, path = self.place.partition("/")
            # the host stands between separators; of the path, the last token may be only the start of one
            text, open_start, open_end = host + slash + path, False, bool(slash)
        else:
            body = self.pattern or ""
            open_start, open_end = not body.startswith("|"), not body.endswith("|")
            text = body.strip("|")
        out = []
        for m in re.finditer(_TOKEN, text.lower()):
            before, after = text[m.start() - 1:m.start()], text[m.end():m.end() + 1]
            if before == "*" or after == "*" or (not before and open_start) or (not after and open_end):
                continue
            out.append(m.group())
        return out


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit(f"({_TOKEN})")))


def token_counts(pages: DataFrame, url: str, rules: Iterable[Rule]) -> dict[str, int]:
    """How many urls contain each token of the rules: one number a token, counted in the tasks before the shuffle."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    hit = F.array_intersect(url_tokens(F.col(url)), F.array(*map(F.lit, wanted)))
    rows = pages.select(F.explode(hit).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


class Index:
    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list] = {}
        self.anywhere: list = []
        for rule in rules:
            tokens = rule.tokens()
            compiled = (re.compile(rule.regex()), rule)
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(compiled)
            else:
                self.anywhere.append(compiled)

    def fitting(self, url: str) -> list[Rule]:
        """All rules that fit a url; ``url`` is what follows the scheme, its host in lower case."""
        tokens = set(re.findall(_TOKEN, url.lower()))
        found = [c for t in tokens for c in self.by_token.get(t, ())] + self.anywhere
        return [rule for expression, rule in found if expression.match(url)]


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host (A to Z lower-cased), path, and the rest from ``?`` or ``#`` on; all empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return host.translate(_LOWER), path, rest[len(host) + len(path):]


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, pattern, verdict of every row.

    The longest fitting place decides; ``rule`` names it. Where none fits, a fitting allow pattern beats block patterns,
    and a url that no rule fits is allowed; ``pattern`` names the pattern that decided, the longest and then the first
    by text. A null url, or one without ``://``, has an empty host and path and is judged like any other.
    """
    size = sum(len(r.place or r.pattern or "") for r in rules)
    if size > MOST:
        raise ValueError(f"{size} characters of rules; split them into lists of {MOST}")
    counts = token_counts(pages, url, rules)
    src = keyed(pages, page_id, url).toDF("page_id", "url")
    rank = lambda x: (-len(x), x)

    def make():
        index = Index(rules, counts)

        def row(r: dict) -> tuple:
            host, path, rest = split_url(r["url"])
            fit = index.fitting(host + path + rest) if host or path else []
            place = min((x for x in fit if x.place is not None), key=lambda x: rank(x.place), default=None)
            if place is not None:
                return r["page_id"], host, path, place.place, None, place.verdict
            allowed = [x.pattern for x in fit if x.verdict == ALLOW]
            named = allowed or [x.pattern for x in fit]
            verdict = BLOCK if named and not allowed else ALLOW
            return r["page_id"], host, path, None, min(named, key=rank, default=None), verdict
        return row

    return per_row(src, make, "page_id long, host string, path string, rule string, pattern string, verdict string", step=4096)


#: Hosts and paths that usually carry advertising, gambling, adult or machine-made pages.
PATTERNS = [Rule(BLOCK, pattern=p) for p in (
    "||ads-track^", "||ads.", "||ad.", "||adserver.", "||adult-", "||porn-", "||sex-", "||xxx.", "||casino-", "||casino.",
    "||poker-", "||free-bets^", "||bets-", "||spam-", "||cheap-pills^", "||pills-", "||doubleclick.", "||tracker.",
    "/wp-login.", "/cgi-bin/", "/adserver/", "/banner/", "/popup/", "|*?affiliate=", "^affid=", "/feed/spam/")
] + [Rule(ALLOW, pattern=p) for p in ("/ads.txt|", "||blog.*/ads/policy^")]
