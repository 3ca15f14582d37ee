"""Personal data by boosted trees over candidate spans.

High-recall generators propose overlapping spans of several kinds.  Gradient
boosted trees score each from its format and its context, and a calibrated
threshold for each kind selects what is redacted.  Spans that meet the strict
base rules are always kept.

The trees are fitted here on a bounded sample of documents.  Candidates that meet
a kind's strict rule are examples for it, those that break it counter-examples.
Each example is also written in other forms in its own context: forms that people
use and the strict rule misses (``name (at) host``, a number without its plus,
dots in a card number) are examples too; broken ones (a wrong check digit, a part
over 255, too few digits, a host without a dot) are counter-examples.  An address whose
letters are not all ASCII, of which the strict rule finds a part only, is an example.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens.functions.frames import map_frames
from civiclens.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCUMENTS = 3000
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 16
PRECISION = 0.98  # each kind's threshold is the lowest that keeps it in cross-validation
CONTEXT = 24  # characters looked at on either side

# fixed patterns of the base kinds
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# the generators' wider patterns
WIDE = {
    "email": re.compile(r"[^\s@<>()\[\],;:\"']{1,64}\s?(?:@|\(at\)|\[at\])\s?[^\s@<>()\[\],;:\"']{2,255}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){2,4}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9][\x20()./0-9-]{5,20}[0-9](?![0-9])"),
}
# fixed words that stand near personal data
CUES = {
    "email": ("mail", "contact", "write", "address", "reach", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "login", "address", "client", "connect"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "dial", "reach", "telefon", "telefono", "appel"),
}

_DIGIT = re.compile(r"[0-9]")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The matches of EMAIL: each holds an @ after the longest run of local
    characters that the match before leaves."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base rules: leftmost matches of each kind that
    pass its check; a match that fails is dropped and not tried again."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if max(map(_number, m.group().split("."))) <= 255]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return ordered(out)


def _number(digits: str) -> int:
    """A part's value; of a part too long for 255 any larger number."""
    d = digits.lstrip("0")
    return int(d or "0") if len(d) <= 3 else 1000


def ordered(spans) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping spans of all generators."""
    out = set()
    if "@" in text or "(at)" in text or "[at]" in text:
        out |= {(m.start(), m.end(), "email") for m in WIDE["email"].finditer(text)}
    if _DIGIT.search(text):
        for kind in ("ip", "card", "phone"):
            out |= {(m.start(), m.end(), kind) for m in WIDE[kind].finditer(text)}
    return ordered(out)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a span."""
    span = text[start:end]
    digits = [c for c in span if "0" <= c <= "9"]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    return [
        len(span),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        sum(c.isalpha() for c in span) / max(1, len(span)),
        span.count("."),
        span.count("-"),
        span.count(" "),
        float(span[:1] == "+"),
        float("(" in span),
        float("@" in span),
        float(luhn("".join(digits))) if 12 <= len(digits) <= 19 else 0.0,
        max((_number(g) for g in groups), default=0),
        len(span.rsplit(".", 1)[-1]) if "." in span else 0,
        float(digits[0]) if digits else -1,
        float(any(c in before for c in CUES[kind])),
        float(any(c in after for c in CUES[kind])),
        float(before[-1:].isspace() or not before),
        float(after[:1] in (" ", "\n", ".", ",", "")),
        sum(c.isdigit() for c in before) / CONTEXT,
        sum(c.isdigit() for c in after) / CONTEXT,
    ]


@dataclass
class Boosted:
    """Logistic gradient boosting with shallow trees over binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    start: float = -5.0
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)  # heap: (feature, bin, leaf value)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), dtype=int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.bins(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree, step = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += step
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray]:
        tree = [(-1, 0, 0.0)] * (2 ** (DEPTH + 1))
        node, step = np.ones(len(g), dtype=int), np.zeros(len(g))
        for n in range(1, 2 ** (DEPTH + 1)):
            rows = np.flatnonzero(node == n)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if n < 2**DEPTH:
                for j in range(b.shape[1]):
                    size = len(self.edges[j]) + 1
                    gl = np.cumsum(np.bincount(b[rows, j], g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, j], h[rows], size))[:-1]
                    if len(gl):
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k)
            if best[1] < 0:
                value = float(RATE * gs / (hs + 1))
                tree[n] = (-1, 0, value)
                step[rows] = value
            else:
                tree[n] = (best[1], best[2], 0.0)
                node[rows] = 2 * n + (b[rows, best[1]] > best[2])
        return tree, step

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b, margin = self.bins(x), np.full(len(x), self.start)
        for tree in self.trees:
            node = np.ones(len(x), dtype=int)
            feature, cut, value = (np.array(c) for c in zip(*tree))
            for _ in range(DEPTH):
                j = feature[node]
                inner = j >= 0
                node[inner] = 2 * node[inner] + (b[np.flatnonzero(inner), j[inner]] > cut[node[inner]])
            margin += value[node]
        return 1 / (1 + np.exp(-margin))


def variants(span: str, kind: str) -> list[tuple[str, int]]:
    """Other ways to write a span, and whether it is still personal data."""
    if kind == "email":
        local, host = span.split("@", 1)
        letters, short = "".join(c for c in local if c.isalpha()), ".".join(host.split(".")[-2:])
        others = [(f"{local[:1]}ö{local[1:]}@{host}", 1), (f"{letters[:1]}ö{letters[1:]}@{short}", 1)]
        return [*others, (f"{local} (at) {host}", 1), (f"{local} [at] {host}", 1), (f"{local}@{host.split('.')[0]}", 0)]
    if kind == "ip":
        parts = span.split(".")
        return [(".".join([*parts[:3], "999"]), 0), (".".join(["300", *parts[1:]]), 0), (span + ".7", 0), (".".join(parts[:3]), 0)]
    digits = "".join(_DIGIT.findall(span))
    if kind == "card":
        dotted = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [(dotted, 1), (wrong, 0), (digits[:7], 0)]
    return [(span[1:], 1), (span.replace(" ", "."), 1), (digits[:4] + "-" + digits[4:7], 0), (digits, 0)]


def _extends(text: str, start: int, end: int, base: tuple[int, int, str]) -> bool:
    """Whether a span is a base address with letters around it that the rule does not know."""
    s, e, _ = base
    more = text[start:s] + text[e:end]
    return start <= s and e <= end and bool(more) and text[end - 1].isalnum() and all(c.isalpha() or c in _LOCAL for c in more)


@dataclass
class Model:
    trees: dict[str, Boosted]
    thresholds: dict[str, float]


def fit(texts: list[str]) -> Model:
    """Trees and thresholds from documents' own candidates.  A kind without both
    examples and counter-examples gets no trees, and only its base spans."""
    x: dict[str, list[list[float]]] = {k: [] for k in KINDS}
    y: dict[str, list[int]] = {k: [] for k in KINDS}
    ends: dict[str, list[int]] = {k: [] for k in KINDS}  # after each text
    for t in texts:
        strict = {(s, e, k) for s, e, k in base_spans(t)}
        for s, e, k in candidates(t):
            x[k].append(features(t, s, e, k))
            y[k].append(int((s, e, k) in strict or any(_extends(t, s, e, b) for b in strict if b[2] == k == "email")))
            if (s, e, k) in strict:
                head, tail = t[max(0, s - CONTEXT) : s], t[e : e + CONTEXT]
                for form, label in variants(t[s:e], k):
                    x[k].append(features(head + form + tail, len(head), len(head) + len(form), k))
                    y[k].append(label)
                    if k == "ip":  # numbers with dots are no phone numbers
                        x["phone"].append(features(head + form + tail, len(head), len(head) + len(form), "phone"))
                        y["phone"].append(0)
        for k in KINDS:
            ends[k].append(len(y[k]))
    model = Model({}, {})
    for k in KINDS:
        a, b = np.asarray(x[k], dtype=float), np.asarray(y[k], dtype=float)
        if len(b) < 20 or b.min() == b.max():
            continue
        with_any = np.diff([0, *ends[k]])[np.diff([0, *ends[k]]) > 0]
        half = np.repeat(np.arange(len(with_any)) % 2, with_any)  # a text's forms stay together
        p = np.zeros(len(b))
        for h in (0, 1):
            if b[half != h].min() != b[half != h].max():
                p[half == h] = Boosted().fit(a[half != h], b[half != h]).predict(a[half == h])
        threshold = 1.01
        for q in np.linspace(0.99, 0.5, 50):
            chosen = p >= q
            if not chosen.any():
                continue
            if b[chosen].mean() < PRECISION:
                break
            threshold = float(q)
        model.trees[k], model.thresholds[k] = Boosted().fit(a, b), threshold
    return model


def sample_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = SAMPLE_DOCUMENTS) -> list[str]:
    """At most ``limit`` documents to learn from, chosen by a hash of the id among
    those with a digit."""
    rows = id_and_text(docs, id_col, text_col).where(F.col("text").rlike("[0-9]") & F.col("doc_id").isNotNull())
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).distinct()
    found = rows.join(F.broadcast(chosen), "doc_id")  # at most `limit` ids
    return [r["text"] for r in found.orderBy("doc_id", "text").limit(limit).collect()]


def _held(text: str, start: int, end: int, base: list[tuple[int, int, str]]) -> bool:
    """Whether a base span holds a span; punctuation at its ends doesn't count."""
    if not any(start < e and s < end for s, e, _ in base):
        return False
    while start < end and not text[start].isalnum():
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    return any(s <= start and end <= e for s, e, _ in base)


def find_spans(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """``(base spans, all spans)`` of each text: base spans, and candidates that the
    trees score over their kind's threshold and that no base span holds whole
    (but for punctuation at their ends)."""
    found, rows = [], {k: [] for k in model.trees}
    for i, t in enumerate(texts):
        base = base_spans(t)
        found.append((base, []))
        for s, e, k in candidates(t):
            if k in rows and not _held(t, s, e, base):
                rows[k].append((i, s, e))
    for k, cs in rows.items():
        if cs:
            p = model.trees[k].predict(np.asarray([features(texts[i], s, e, k) for i, s, e in cs], dtype=float))
            for (i, s, e), v in zip(cs, p):
                if v >= model.thresholds[k]:
                    found[i][1].append((s, e, k))
    return [(base, ordered(base + more)) for base, more in found]


def written_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans) -> str:
    """The text with each span, and what overlaps it, as ``[KIND]``."""
    out, at, open_end = [], 0, -1
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s < open_end:
            open_end = max(open_end, e)
            at = open_end
            continue
        out.append(text[at:s] + f"[{k.upper()}]")
        at = open_end = e
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base string, spans string, redacted string``, one row per input
    row; spans are ``kind:start:end`` in code points, end exclusive.  NULL and empty
    texts have no spans and an empty redacted text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            spans = find_spans(texts, shared.value)
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"],
                    "base": [written_spans(b) for b, _ in spans],
                    "spans": [written_spans(a) for _, a in spans],
                    "redacted": [redact(t, a) for t, (_, a) in zip(texts, spans)],
                }
            )

    return map_frames(id_and_text(docs, id_col, text_col), find, "doc_id long, base string, spans string, redacted string")


def redact_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; NULL stays NULL."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def cleaned(text: pd.Series) -> pd.Series:
        whole = text.fillna("").tolist()
        out = pd.Series([redact(t, a) for t, (_, a) in zip(whole, find_spans(whole, shared.value))], index=text.index, dtype=object)
        return out.where(text.notna(), None)

    return docs.withColumn(text_col, cleaned(F.col(text_col)))
