"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Candidates are the base spans (fixed patterns with their checks) and look-alikes of the same four kinds: spelled-out
mail addresses, IPv6 addresses, card numbers in other separators, phone numbers without a plus, and matches of the base
patterns that fail their checks. On each candidate six labelers vote yes, no or nothing:

- pattern: yes for a base span, no for a match that fails its check;
- checksum: Luhn, a well-formed address, digit counts;
- gazetteer: top-level domains, issuer digits, address blocks, dialling forms;
- context: words before the span that announce it, or something else;
- edges: no where a letter or a sign of code touches the span;
- calendar: no for dates, times and rows of years.

Votes are counted by pattern over all documents. Expectation-maximisation (Dawid and Skene) on these counts estimates how
often each labeler is right on true and on false spans of a kind; a labeler that says nothing tells nothing, pseudo-counts
(PRIOR) hold what is assumed before any vote, and base spans and look-alikes have shares of true spans of their own. The label
model gives each pattern a posterior, and a logistic classifier over votes and shape is trained on the posteriors of the
counted patterns and, with little weight, of all possible ones. Base spans always stay; a look-alike is added where the
classifier gives ADD or more and it overlaps no base span. One narrow scan finds candidates; only vote counts reach the driver.
"""

from __future__ import annotations

import hashlib
import ipaddress
import itertools
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearstack.llm.common import arrow_map, materialize, prepare

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "edges", "calendar")
SHAPES = 8
ADD = 0.9
#: Pseudo-counts of right and wrong votes of each labeler, and of true and false look-alikes (base spans: the other way round).
PRIOR, LOOSE = (9.0, 1.0), (1.0, 3.0)
#: Weight in training of a vote pattern that was not counted.
UNSEEN = 0.25
_ROUNDS = 50

# The gazetteers and cue words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io ai co dev app de fr es it uk us ca au jp cn in br nl se no fi dk pl ch at be pt ru eu mx ar cl ie nz za kr".split())
CUES = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write to|correo|courriel|adresse|kontakt)\W{0,12}$"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|addr|login from|adresse|servidor)\W{0,12}$"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|amex|credit|payment|carte|tarjeta|karte)\W{0,12}$"),
    "phone": re.compile(r"(?i)\b(phone|tel|telephone|call|fax|mobile|cell|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone)\W{0,12}$"),
}
OTHER_CUES = re.compile(r"(?i)\b(isbn|issn|doi|version|v|order|invoice|id|no|nr|token|sha\d*|md5|hash|key|page|section|figure|table|serial|part|year|build|release)\W{0,12}$")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: As the base pattern: a run of digits is taken whole, and a match can't begin within one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DOT_WORD = re.compile(r"(?i)\sdot\s")
_SPELLED = re.compile(r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[A-Z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[A-Z0-9-]{1,63}){1,4}")
_IN_WORDS = re.compile(r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64} at [A-Z0-9-]{1,63}(?: dot [A-Z0-9-]{2,63}){1,4}(?![A-Z0-9-])")
_IP6 = re.compile(r"(?i)(?<![0-9a-z:.])(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?)(?![0-9a-z:.])")
_CARD_GROUPS = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20./_\u00a0\u2010-\u2015-]{1,3}[0-9]{2,7}){2,4}(?![0-9A-Za-z])")
_PHONE_GROUPS = re.compile(r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z.-])")
_YEAR, _DAY = "(?:19|20)[0-9]{2}", "[0-9]{1,2}"
_CALENDAR = re.compile(rf"(?<![0-9]){_YEAR}[-./ ]{_DAY}[-./ ]{_DAY}(?![0-9])|(?<![0-9]){_DAY}[-./ ]{_DAY}[-./ ]{_YEAR}(?![0-9])|(?<![0-9]){_YEAR}(?:[-./ ]{{1,3}}{_YEAR})+(?![0-9])")
_US_PHONE = re.compile(r"\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}")

Span = tuple[int, int]


def _digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(s: str) -> bool:
    d = _digits(s)[::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def emails(text: str) -> list[Span]:
    """Leftmost matches of the base pattern, found from their @: linear in the text, also without matches."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> dict[str, list[Span]]:
    """The base spans of a text by kind, in order; offsets are code points."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not text:
        return out
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if _is_ip(m[0])]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(_digits(m[0])) <= 19 and luhn(m[0])]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _failing(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns that fail their checks, of a length that might be taken for the kind."""
    out = [("ip", *m.span()) for m in _IP.finditer(text) if not _is_ip(m[0]) and m.end() - m.start() <= 15]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() <= 37 and 13 <= len(_digits(m[0])) <= 19 and not luhn(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if len(_digits(m[0])) in (7, 8, 16, 17)]
    return out


def look_alikes(text: str | None, base: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    """Looser candidates that overlap no base span; of those of a kind that overlap each other the leftmost, then the longest."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    if "[" in text or "(" in text or "{" in text:
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if _DOT_WORD.search(text):
        out += [("email", *m.span()) for m in _IN_WORDS.finditer(text)]
    if "::" in text or text.count(":") >= 7:
        out += [("ip", *m.span()) for m in _IP6.finditer(text) if m.end() - m.start() > 2]
    if _DIGIT.search(text):
        out += _failing(text)
        out += [("card", *m.span()) for m in _CARD_GROUPS.finditer(text) if 13 <= len(_digits(m[0])) <= 19 and not _CARD.fullmatch(m[0])]
        out += [("phone", *m.span()) for m in _PHONE_GROUPS.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    taken = sorted(s for spans in base.values() for s in spans)
    kept, i = [], 0
    end = dict.fromkeys(KINDS, 0)
    for kind, a, b in sorted(out, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if (i == len(taken) or taken[i][0] >= b) and end[kind] <= a:
            end[kind] = b
            kept.append((kind, a, b))
    return kept


def accepted(more: list[tuple[str, int, int]], patterns: list[str], model: SpanClassifier) -> list[tuple[str, int, int]]:
    """Of look-alikes with their patterns those that reach ADD; of those that overlap the likeliest, then the leftmost."""
    likely = sorted((-p, a, b, kind) for (kind, a, b), p in zip(more, map(model.probability, patterns), strict=True) if p >= ADD)
    kept: list[tuple[str, int, int]] = []
    for _, a, b, kind in likely:
        if all(b <= x or y <= a for _, x, y in kept):
            kept.append((kind, a, b))
    return kept


def _base_shape(kind: str, s: str) -> bool:
    return kind != "email" and {"ip": _IP, "card": _CARD, "phone": _PHONE}[kind].fullmatch(s) is not None


def _is_ip6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def _email_votes(s: str) -> tuple[int, int]:
    parts = re.split(r"[^a-z0-9]+", s.lower().rstrip(" ])}"))
    spelled = "@" in s or _SPELLED.fullmatch(s) is not None
    return int(spelled and parts[-1].isalpha()), 1 if parts[-1] in TOP_DOMAINS else 0 if "@" in s else 2


def _ip_votes(s: str) -> tuple[int, int]:
    if ":" in s:
        first = int(s.split(":")[0] or "0", 16)
        return 1 if _is_ip6(s) else 2, 1 if first >> 13 == 1 or first >> 9 == 0x7E or first >> 6 == 0x3FA else 2
    first = s.split(".")[0].lstrip("0")
    return 1 if _is_ip(s) else 2, 2 if first in ("", "127", "255") else 1


def _card_votes(s: str) -> tuple[int, int]:
    d = _digits(s)
    issuer = {3: (14, 15), 4: (13, 16, 19), 5: (16,), 6: (16, 17, 18, 19), 2: (16,)}
    return 1 if 13 <= len(d) <= 19 and luhn(s) else 2, 1 if len(d) in issuer.get(d[0], ()) else 2


def _phone_votes(s: str) -> tuple[int, int]:
    good = 9 <= len(_digits(s)) <= 15
    return (1 if s.startswith("+") else 0) if good else 2, 1 if s.startswith(("+", "00")) or _US_PHONE.fullmatch(s) else 0


_OWN = {"email": _email_votes, "ip": _ip_votes, "card": _card_votes, "phone": _phone_votes}


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[tuple[int, ...], int]:
    """The labelers' votes (1 yes, 2 no, 0 nothing) and a shape class under SHAPES."""
    s = text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 1]
    pattern = 1 if strict else 2 if _base_shape(kind, s) else 0
    checksum, gazetteer = _OWN[kind](s)
    context = 1 if CUES[kind].search(before) else 2 if OTHER_CUES.search(before) else 0
    edges = 2 if any(c.isalnum() or c in "=_/#\\" for c in before[-1:] + after) else 0
    calendar = 2 if kind in ("card", "phone") and not strict and _CALENDAR.search(s) else 0
    shape = (1 if " " in s else 0) + (2 if "-" in s or "." in s else 0) + (4 if "(" in s or "[" in s else 0)
    return (pattern, checksum, gazetteer, context, edges, calendar), shape


def candidates(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, base spans and look-alikes as kind:start:end, and each one's pattern kind|votes|shape."""

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "base", "looser", "patterns")}
        for i, text in zip(b["doc_id"], b["text"], strict=True):
            base = base_spans(text)
            more = look_alikes(text, base)
            every = [(k, a, e, True) for k in KINDS for a, e in base[k]] + [(k, a, e, False) for k, a, e in more]
            out["doc_id"].append(i)
            out["base"].append([f"{k}:{a}:{e}" for k in KINDS for a, e in base[k]])
            out["looser"].append([f"{k}:{a}:{e}" for k, a, e in more])
            out["patterns"].append([_pattern(text, *c) for c in every])
        return out

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, base array<string>, looser array<string>, patterns array<string>")


def _pattern(text: str, kind: str, start: int, end: int, strict: bool) -> str:
    v, shape = votes(text, kind, start, end, strict)
    return f"{kind}|{''.join(map(str, v))}|{shape}"


class LabelModel:
    """Of each kind the share of true spans among base spans and look-alikes, and how often each labeler says yes on true and false ones."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.share: dict[str, np.ndarray] = {}  # by kind: of look-alikes, of base spans
        self.yes: dict[str, np.ndarray] = {}  # by kind: (labeler, truth)
        for kind in KINDS:
            own = sorted(p for p in counts if p.startswith(kind + "|"))
            v = np.array([[int(c) for c in p.split("|")[1]] for p in own], int).reshape(len(own), len(LABELERS))
            self._fit(kind, v, np.array([counts[p] for p in own], float))

    def _fit(self, kind: str, v: np.ndarray, n: np.ndarray) -> None:
        right, wrong = PRIOR
        # Before any count: what the pseudo-counts say.
        self.share[kind] = np.array([LOOSE[0], LOOSE[1]]) / sum(LOOSE)
        self.yes[kind] = np.tile(np.array([wrong, right]) / (right + wrong), (len(LABELERS), 1))
        strict = (v[:, 0] == 1).astype(int)
        for _ in range(_ROUNDS if len(v) else 0):
            q = self.posteriors(kind, v)
            for g in (0, 1):
                of = (strict == g) * n
                self.share[kind][g] = (of @ q + LOOSE[g]) / (of.sum() + sum(LOOSE))
            for j in range(len(LABELERS)):
                yes, voted = (v[:, j] == 1) * n, (v[:, j] > 0) * n
                self.yes[kind][j] = (yes @ (1 - q) + wrong) / (voted @ (1 - q) + right + wrong), (yes @ q + right) / (voted @ q + right + wrong)

    def posteriors(self, kind: str, v: np.ndarray) -> np.ndarray:
        """P(true) of rows of votes."""
        share = self.share[kind][(v[:, 0] == 1).astype(int)]
        score = np.log(share / (1 - share))
        for j in range(len(LABELERS)):
            false, true = self.yes[kind][j]
            score = score + np.where(v[:, j] == 1, np.log(true / false), np.where(v[:, j] == 2, np.log((1 - true) / (1 - false)), 0.0))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _features(kind: str, v: Sequence[int], shape: int) -> np.ndarray:
    x = np.zeros(len(KINDS) * (1 + 2 * len(LABELERS)) + SHAPES)
    base = KINDS.index(kind) * (1 + 2 * len(LABELERS))
    x[base] = 1
    for j, c in enumerate(v):
        if c:
            x[base + 2 * j + c] = 1
    x[-SHAPES + shape] = 1
    return x


def _parsed(pattern: str) -> tuple[str, tuple[int, ...], int]:
    kind, v, shape = pattern.split("|")
    return kind, tuple(map(int, v)), int(shape)


class SpanClassifier:
    """Logistic regression over votes and shape, trained on the label model's posteriors by Newton steps.

    Counted patterns weigh the root of their count, so frequent ones count more, yet don't drown the rest.
    """

    def __init__(self, counts: dict[str, int]) -> None:
        self.model = LabelModel(counts)
        rows = [(*_parsed(p), float(np.sqrt(counts[p]))) for p in sorted(counts)]
        rows += [(kind, v, 0, UNSEEN) for kind in KINDS for v in itertools.product(range(3), repeat=len(LABELERS)) if v[4] != 1 and v[5] != 1]
        x = np.array([_features(*r[:3]) for r in rows])
        q = np.array([self.model.posteriors(r[0], np.array([r[1]]))[0] for r in rows])
        n = np.array([r[3] for r in rows])
        self.weights = np.zeros(x.shape[1])
        self._known: dict[str, float] = {}
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
            self.weights += np.linalg.solve(hessian, x.T @ (n * (q - p)) - 0.1 * self.weights)

    def probability(self, pattern: str) -> float:
        if pattern not in self._known:  # patterns are few
            self._known[pattern] = float(1 / (1 + np.exp(-np.clip(_features(*_parsed(pattern)) @ self.weights, -30, 30))))
        return self._known[pattern]


def train(found: DataFrame) -> SpanClassifier:
    """A classifier from candidates(); the number of patterns is bounded by kinds, votes and shapes."""
    counts = found.select(F.explode("patterns").alias("p")).groupBy("p").count().collect()
    return SpanClassifier({r[0]: r[1] for r in counts})


def outcomes(found: DataFrame, model: SpanClassifier) -> dict[tuple[str, str], int]:
    """How many candidates of each kind are base spans, accepted and rejected, from candidates()."""
    counts = found.select(F.explode("patterns").alias("p")).groupBy("p").count().collect()
    out: dict[tuple[str, str], int] = {}
    for p, n in counts:
        kind, v, _ = _parsed(p)
        key = kind, "base" if v[0] == 1 else "accepted" if model.probability(p) >= ADD else "rejected"
        out[key] = out.get(key, 0) + n
    return out


def spans_in_order(spans: list[str]) -> list[str]:
    return sorted(spans, key=lambda s: (KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans, base_sha256 and all spans of each row of docs (doc_id, text).

    A null text is empty and has no spans; repeated rows and ids are each answered, null ids stay; other columns are not read; an
    empty table gives no rows. Spans are kind:start:end in code points, by kind as in KINDS, then by start.
    """
    found = materialize(candidates(docs), "pii-candidates")
    model = train(found)

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for i, base, more, patterns in zip(b["doc_id"], b["base"], b["looser"], b["patterns"], strict=True):
            loose = [(k, int(a), int(e)) for k, a, e in (s.split(":") for s in more)]
            added = [f"{k}:{a}:{e}" for k, a, e in accepted(loose, patterns[len(base) :], model)]
            out["doc_id"].append(i)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s.startswith(k) for s in base))
            out["base_sha256"].append(hashlib.sha256(",".join(base).encode()).hexdigest())
            out["spans"].append(",".join(spans_in_order(base + added)))
        return out

    return arrow_map(found, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str | None, model: SpanClassifier) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    if not text:
        return text
    base = base_spans(text)
    spans = [(a, e, k) for k in KINDS for a, e in base[k]]
    more = look_alikes(text, base)
    spans += [(a, e, k) for k, a, e in accepted(more, [_pattern(text, k, a, e, False) for k, a, e in more], model)]
    if not spans:
        return text
    out, end = [], 0
    for a, e, k in sorted(spans):
        if a >= end:
            out += [text[end:a], f"<{k.upper()}>"]
        end = max(end, e)
    return "".join(out) + text[end:]


def redacted(model: SpanClassifier, text: Column | str) -> Column:
    """A column with the redacted text; null stays null."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return pd.Series([redact_text(x if isinstance(x, str) else None, model) for x in s], dtype=object)

    return f(text)


def train_on(docs: DataFrame) -> SpanClassifier:
    prepare(docs.sparkSession)
    return train(candidates(docs))
