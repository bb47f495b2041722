"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans; loose patterns give further candidates (addresses written around, numbers in
national form, addresses of the longer internet protocol, ungrouped digits). Labelers vote on every candidate of either
sort: its shape, a check on its value, a gazetteer, the words around it, and what touches it. The votes of all documents
are counted by pattern. Expectation-maximisation over these counts estimates how reliable each labeler is for each kind
and how likely each pattern is a real find; a logistic span classifier is trained on these probabilities and decides on
the candidates that are no base spans. Base spans stay whatever it says.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "value", "gazetteer", "context", "edge")
_EDGE = "\x01"
#: Characters of context on each side of a candidate.
AROUND = 40
_BLOCK = 256

# Strict patterns. Possessive loops never back up, and a candidate starts where a run starts or where the last match
# ended, so that long runs are read once; both leave the matches as they are.
_START = r"(?:\G|(?<![{0}]))"
STRICT = {
    "email": _START.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _START.format("0-9") + r"[0-9]++(?:\.[0-9]++){3}+",
    # the whole run of digits with single separators, 12 to 19 of them; other runs fail by their length
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]++"
             r"(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+])(?<![0-9+][\x20().-])\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Word lists and ranges the labelers look up.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "info", "biz", "io", "de", "fr", "es", "uk", "it", "nl", "ch", "at")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
                 "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84",
                 "86", "90", "91", "92", "351", "352", "353", "358", "420", "421")
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|65|62)"
RESERVED_IP = r"^(?:0+|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address|adresse|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|logged|client|user|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta|cvv|expir\w*)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono|whatsapp|sms)\b",
}
AGAINST = (r"(?i)\b(?:version|isbn|issn|order|invoice|price|sku|serial|release|section|chapter|token|secret|hash|id|key)"
           r"\b[^.\n]*$")


def _running(lengths: Column, start: Column) -> Column:
    """Where each of some lengths begins."""
    step = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    return let(F.aggregate(lengths, F.array(start), step), lambda sums: F.slice(sums, F.lit(1), F.size(lengths)))


def _starts(lengths: Column) -> Column:
    """Running sums in two levels, so that a row with very many parts copies blocks and not everything before."""
    zero = F.lit(0)
    cut = F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
                      lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))

    def sums(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, n: a + n))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("x"), _running(totals, zero).alias("s")),
                                     lambda z: _running(z["x"], z["s"])))

    return let(cut, sums)


def _spans(text: Column, pattern: str, number: int, strict: bool, hint: str) -> Column:
    """Array of (start, kind, end, strict, value, before, after) of a pattern's matches; offsets are code points."""
    def located(parts: Column) -> Column:
        starts = let(F.transform(parts, F.char_length), _starts)
        odd = F.filter(F.arrays_zip(parts.alias("v"), starts.alias("s")), lambda x, i: i % 2 == 1)
        return F.transform(odd, lambda x: F.struct(
            x["s"].alias("start"), F.lit(number).alias("kind"), (x["s"] + F.char_length(x["v"])).alias("end"),
            F.lit(strict).alias("strict"), x["v"].alias("value"),
            F.substring(text, F.greatest(x["s"] + 1 - AROUND, F.lit(1)), F.least(x["s"], F.lit(AROUND))).alias("before"),
            F.substring(text, x["s"] + F.char_length(x["v"]) + 1, F.lit(AROUND)).alias("after")))

    marked = F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{_EDGE}$1{_EDGE}")), _EDGE, -1)
    # a text without what the kind cannot do without is neither marked nor split
    return F.when(text.rlike(hint), let(marked, located)).otherwise(F.filter(F.array(_nothing()), lambda x: F.lit(False)))


def _nothing() -> Column:
    return F.struct(F.lit(0).alias("start"), F.lit(0).alias("kind"), F.lit(0).alias("end"), F.lit(False).alias("strict"),
                    F.lit("").alias("value"), F.lit("").alias("before"), F.lit("").alias("after"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    places = F.sequence(F.lit(1), F.char_length(turned))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.coalesce(F.aggregate(places, F.lit(0), add) % 10 == 0, F.lit(False))


def _valid(kind: str, value: Column) -> Column:
    """What a strict match has to pass to be a base span."""
    if kind == "ip":
        return value.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})){3}$")
    if kind == "card":
        return F.char_length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _candidates(text: Column) -> tuple[Column, Column]:
    """The base spans and the loose candidates of a text column without nulls and edge marks."""
    hints = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
    loose_hints = {"email": r"(?i)[\[({]\x20?at\x20?[\])}]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": hints["card"],
                   "phone": r"[0-9][\x20.-][0-9]{4}"}
    base, more = [], []
    for n, kind in enumerate(KINDS):
        spans = _spans(text, STRICT[kind], n, True, hints[kind])
        base.append(let(spans, lambda s: F.filter(s, _valid_of(kind))))
        more.append(_spans(text, LOOSE[kind], n, False, loose_hints[kind]))
    return F.array_sort(F.concat(*base)), F.array_sort(F.concat(*more))


def _valid_of(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["value"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's columns with ``base`` and ``more``: base spans, and candidates that touch none of them.

    A null text counts as empty. Offsets count code points of the whole text, ends exclusive.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    plain = F.when(F.contains(plain, F.lit(_EDGE)), F.translate(plain, _EDGE, "\x02")).otherwise(plain)
    base, more = _candidates(F.col("_plain"))
    out = docs.withColumn("_plain", plain).select(*map(F.col, docs.columns), base.alias("base"), more.alias("more"))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return out.withColumn("more", F.filter("more", apart))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return out.when(no, F.lit(-1)).otherwise(F.lit(0)) if no is not None else out.otherwise(F.lit(0))


def votes(x: Column) -> Column:
    """Struct of the labelers' votes (1, 0, -1) on one candidate."""
    kind = x["kind"]
    value, digits = x["value"], _digits(x["value"])
    tld = F.lower(F.regexp_extract(F.substring(value, -AROUND, AROUND), r"([A-Za-z0-9-]+)\W*$", 1))
    pick = lambda *by: F.element_at(F.array(*by), kind + 1)
    sound = pick(tld.rlike("^[a-z]{2,}$"), _valid("ip", value) | value.contains(":"),
                 _valid("card", value), F.char_length(digits).between(9, 15))
    listed = pick(tld.isin(*DOMAINS), ~value.rlike(RESERVED_IP), digits.rlike(CARD_PREFIX),
                  F.when(value.startswith("+"), digits.rlike("^(?:" + "|".join(COUNTRY_CODES) + ")"))
                  .otherwise(digits.rlike("^[2-9][0-9]{2}[2-9]")))
    around = F.concat_ws(" ", x["before"], x["after"])
    cue = pick(*(around.rlike(CUES[k]) for k in KINDS))
    touched = x["before"].rlike(r"[\p{L}\p{N}]$") | x["after"].rlike(r"^[\p{L}\p{N}]")
    return F.struct(
        _vote(x["strict"]).alias("shape"), _vote(sound, ~sound).alias("value"),
        _vote(listed, ~listed).alias("gazetteer"), _vote(cue, x["before"].rlike(AGAINST)).alias("context"),
        _vote(~touched, touched).alias("edge"))


@dataclass(frozen=True)
class Model:
    """By kind: the share of real finds, each labeler's reliability, and the span classifier's weights."""
    prior: dict[str, float] = field(default_factory=dict)
    reliability: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    weights: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def accept(self, x: Column) -> Column:
        """The classifier's decision on one candidate."""
        def score(v: Column) -> Column:
            z = F.lit(-1.0)
            for n, kind in enumerate(KINDS):
                if w := self.weights.get(kind):
                    of = sum((v[name] * F.lit(b) for name, b in zip(LABELERS, w[1:])), F.lit(w[0]))
                    z = F.when(x["kind"] == n, of).otherwise(z)
            return z

        return let(votes(x), score) >= 0


def _patterns(scanned: DataFrame) -> list:
    """How often each vote pattern occurs in all documents: at most 4 x 3^5 rows, whatever the corpus."""
    each = scanned.select(F.explode(F.concat("base", "more")).alias("x")).select(F.col("x.kind").alias("kind"), votes(F.col("x")).alias("v"))
    return each.groupBy("kind", "v").count().collect()


def fit(scanned: DataFrame, rounds: int = 200, tolerance: float = 1e-9) -> Model:
    """Estimate reliabilities by EM on the vote counts, then train the classifier on the probabilities.

    Base spans are taken as real and candidates that fail the check on their value as not; the rest is estimated.
    Labelers start out as right nine times in ten, which also counts as ten votes; abstentions say nothing.
    A kind without candidates gets no classifier, and so no further spans.
    """
    by_kind: dict[str, dict[tuple, int]] = {}
    for r in _patterns(scanned):
        by_kind.setdefault(KINDS[r["kind"]], {})[tuple(r["v"])] = r["count"]
    model = Model()
    for kind, counts in sorted(by_kind.items()):
        patterns = sorted(counts.items())
        prior, rate = 0.5, [(0.9, 0.1)] * len(LABELERS)
        post: list[float] = []
        for _ in range(rounds):
            post = []
            for v, _n in patterns:
                z = math.log(prior / (1 - prior))
                for (t, f), vote in zip(rate, v):
                    z += vote and (math.log(t / f) if vote > 0 else math.log((1 - t) / (1 - f)))
                post.append(1.0 if v[0] > 0 else 0.0 if v[1] < 0 else 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            total = sum(n for _, n in patterns)
            yes = sum(n * p for (_, n), p in zip(patterns, post))
            now, old = [], [prior, *(x for pair in rate for x in pair)]
            for k in range(len(LABELERS)):
                pair = []
                for side in (True, False):
                    up, down = (9.0, 1.0) if side else (1.0, 9.0)
                    for (v, n), p in zip(patterns, post):
                        w = n * (p if side else 1 - p)
                        up, down = up + w * (v[k] > 0), down + w * (v[k] < 0)
                    pair.append(up / (up + down))
                now.append((pair[0], pair[1]))
            prior, rate = min(0.999, max(0.001, (yes + 1) / (total + 2))), now
            if max(abs(a - b) for a, b in zip(old, [prior, *(x for pair in rate for x in pair)])) < tolerance:
                break
        model.prior[kind] = prior
        model.reliability.update({(kind, name): r for name, r in zip(LABELERS, rate)})
        model.weights[kind] = _logistic([(1.0, *map(float, v)) for v, _ in patterns], post, [float(n) for _, n in patterns])
    return model


def _logistic(x: list[tuple[float, ...]], y: list[float], n: list[float], penalty: float = 1.0, steps: int = 5000) -> tuple[float, ...]:
    """Weighted logistic regression on soft labels by gradient steps over the distinct patterns."""
    w = [0.0] * len(x[0])
    total = sum(n)
    for _ in range(steps):
        grad = [penalty / total * v for v in w]
        grad[0] = 0.0
        for row, label, count in zip(x, y, n):
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(a * b for a, b in zip(w, row))))))
            for j, a in enumerate(row):
                grad[j] += count / total * (p - label) * a
        w = [a - 0.7 * g for a, g in zip(w, grad)]
        if max(map(abs, grad)) < 1e-6:
            break
    return tuple(w)


def found(scanned: DataFrame, model: Model) -> DataFrame:
    """``scanned`` with ``spans``: the base spans and the accepted ones of the others, by start and kind."""
    extra = F.filter("more", model.accept)
    return scanned.withColumn("spans", F.array_sort(F.concat("base", extra)))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    state = F.aggregate(
        spans, F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(x["start"] >= acc["at"], F.concat(acc["parts"], F.array(
                F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1))))
            .otherwise(acc["parts"]).alias("parts"),
            F.greatest(acc["at"], x["end"]).alias("at")))
    clean = F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, clean).otherwise(text)
