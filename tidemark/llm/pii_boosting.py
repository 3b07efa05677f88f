"""Personal data: generators propose spans, boosted trees judge them by format and context, calibrated thresholds select.

Spans of the base rules are always selected. Beyond them, generous generators propose spans that may overlap (addresses
written with words, numbers with unusual separators, phone numbers without a plus). The trees learn from the corpus itself:
base spans and rewritten forms of them are positive, spoilt forms of them and other proposals are negative.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What every written address has, and what every proposal has: a text without it has none, so nothing is lost by skipping it.
_WRITTEN = re.compile(r"@|[\[(]\s?at\s?[\])]|\sat\s\s?[\w-]{1,63}\s?(?:\.|[\[(]|\sdot\s)", re.IGNORECASE)
_ANY = re.compile(rf"\d|{_WRITTEN.pattern}", re.IGNORECASE)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest run of local characters before it and a dotted name after it: one step per character."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        begin = at
        if domain:
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
        if begin < at:
            yield begin, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Dotted numbers, four at a time."""
    for run in _DOTTED.finditer(text):
        if "." not in run[0]:
            continue
        parts = run[0].split(".")
        place = run.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[i : i + 4]):
                yield place, place + size
            place += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start."""
    out = [(0, b, e) for b, e in base_emails(text)]
    out += [(1, b, e) for b, e in base_addresses(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


# Generators: generous, and bounded in length so that each is linear in the text.
_AT, _DOT = r"\s?(?:@|[\[(]\s?at\s?[\])]|\sat\s)\s?", r"\s?(?:\.|[\[(]\s?dot\s?[\])]|\sdot\s)\s?"
_GENERATORS = (
    re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{1,4}}", re.IGNORECASE),
    re.compile(r"(?<!\d)\d{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?\d{1,3}){3}(?!\d)"),
    re.compile(r"(?<!\d)\d(?:[ ./_-]{0,3}\d){12,18}(?!\d)"),
    re.compile(r"(?<!\d)(?:(?:\+|00)[ (]{0,2}|\()?\d(?:[ ()./-]{0,3}\d){6,14}(?!\d)"),
)
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)")  # numbers that touch others, taken alone
_HINTS = (
    re.compile(r"mail|contact|write|@|correo|courriel", re.IGNORECASE), re.compile(r"\bip\b|host|server|addr", re.IGNORECASE),
    re.compile(r"card|visa|credit|karte|tarjeta|carte|pay", re.IGNORECASE), re.compile(r"tel|phone|call|mobil|fax|llam", re.IGNORECASE),
)
_DATE = re.compile(r"(?:19|20)\d\d\D{1,3}[01]?\d\D{1,3}[0-3]?\d")
FEATURES = (
    "email", "ip", "card", "phone", "length", "digits", "groups", "plus", "round", "dashes", "dots", "blanks", "slashes", "luhn", "octets", "at", "written", "last",
    "left", "right", "hint", "lead", "date",
)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of everything that could be personal data; spans may overlap."""
    if not _ANY.search(text):
        return []
    written = _WRITTEN.search(text)
    found = [(k, *m.span()) for k, g in enumerate(_GENERATORS) if k or written for m in g.finditer(text)]
    return list(dict.fromkeys(found + [(2, *m.span()) for m in _CARD.finditer(text)]))


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and of what stands around it."""
    span, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 4]
    digits = _only_digits(span)
    groups = re.findall(r"[0-9]+", span)
    edge = [0.0 if not c or c.isspace() else 1.0 if c.isalnum() else 2.0 for c in (left[-1:], right[:1])]
    return [
        *(float(kind == k) for k in range(4)), float(len(span)), float(len(digits)), float(len(groups)), float("+" in span), float("(" in span), float(span.count("-")), float(span.count(".")),
        float(span.count(" ")), float(span.count("/")), float(bool(digits) and luhn(digits)), float(len(groups) >= 4 and all(int(g) <= 255 for g in groups[-4:])), float("@" in span),
        float(bool(re.search(r"\b(?:at|dot)\b", span, re.IGNORECASE))), float(len(re.split(r"\W", span)[-1])), *edge, float(bool(_HINTS[kind].search(left))),
        float(int(digits[0])) if digits else -1.0, float(bool(_DATE.search(span))),
    ]


def variants(kind: int, span: str) -> list[tuple[str, int]]:
    """Rewritten (1) and spoilt (0) forms of a base span."""
    digits = _only_digits(span)
    if kind == 0:
        name, _, host = span.partition("@")
        return [(f"{name} (at) {host}", 1), (f"{name} [at] {host.replace('.', ' [dot] ')}", 1), (f"{name} at {host.replace('.', ' dot ')}", 1), (f"{name} at {host.replace('.', ' ')}", 0), (f"{name}.{host}", 0)]
    if kind == 1:
        return [(span.replace(".", "[.]"), 1), (span.replace(".", " . "), 1), (".".join(str(int(p) + 300) for p in span.split(".")), 0), (span.rpartition(".")[0], 0)]
    if kind == 2:
        spoilt = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [(".".join(four), 1), ("/".join(four), 1), (spoilt, 0), (" ".join(spoilt[i : i + 4] for i in range(0, len(spoilt), 4)), 0), (digits[:12], 0)]
    bare = span.lstrip("+")
    return [(f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", 1), (f"00{bare}", 1), (digits[:6], 0), (digits, 0), (f"20{digits[:2]}-0{digits[2:3]}-1{digits[3:4]} {digits[4:7]}", 0)]


def examples(text: str) -> Iterator[tuple[list[float], int]]:
    """Labelled proposals of one text: its own, and those of rewritten and spoilt forms put in the place of its base spans.
    Own proposals that no base rule confirms are negative, but for those that may be right: they have no label."""
    base = base_spans(text)
    for kind, b, e in proposals(text):
        open_case = kind == 2 and luhn(_only_digits(text[b:e])) or kind == 3 and "+" in text[b:e]
        if not open_case and not any(s < e and b < t for _, s, t in base):
            yield features(text, kind, b, e), 0
    for kind, b, e in base:
        for form, label in [(text[b:e], 1), *variants(kind, text[b:e])]:
            left = text[max(0, b - 40) : b]
            window = left + form + text[e : e + 40]
            for k, s, t in proposals(window):
                overlap = min(t, len(left) + len(form)) - max(s, len(left))
                if overlap * 10 >= 9 * len(form) and t - s <= len(form) + 2 and (k == kind or not label):
                    yield features(window, k, s, t), label


@dataclass(frozen=True)
class Boosting:
    """`rows`: labelled proposals with the smallest hash that the trees are fitted and calibrated on; every fourth one is held
    out for calibration. `confident` is the calibrated probability from which a proposal is selected."""

    rows: int = 20_000
    trees: int = 10
    depth: int = 3
    confident: float = 0.95


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, threshold, left, right) or leaf values, with weights; bias and slope of the calibration."""

    trees: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    bias: float = -20.0
    slope: float = 0.0
    confident: float = 0.95

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for tree, weight in zip(self.trees, self.weights, strict=True):
            margin += weight * _walk(tree, x)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * margin, -30, 30)))


def _walk(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    at, threshold, left, right = node
    return np.where(x[:, at] <= threshold, _walk(left, x), _walk(right, x))


def _exported(node):
    """A fitted tree's node as nested tuples."""
    if node.numDescendants() == 0:
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _exported(node.leftChild()), _exported(node.rightChild()))


def train(docs: DataFrame, text_column: str = "text", cfg: Boosting = Boosting()) -> Model:
    """Fit boosted trees on a bounded sample of labelled proposals. A table without base spans gives a model that selects nothing more."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    from tidemark.llm.compression_quality import calibration

    def run(batches):
        for batch in batches:
            xs, ys = [], []
            for text in batch.column(0):
                value = text.as_py()
                if value and _ANY.search(value):
                    for x, y in examples(value):
                        xs.append(x)
                        ys.append(float(y))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], names=["x", "label"])

    found = docs.select(F.col(f"`{text_column}`").cast("string")).mapInArrow(run, "x array<double>, label double")
    order = F.xxhash64("x", "label")
    sample = shared_table(found.withColumn("h", order).distinct().orderBy("h").limit(cfg.rows), "pii-examples")
    fit, held = sample.where("h % 4 != 0"), sample.where("h % 4 = 0")
    if fit.select("label").distinct().count() < 2 or held.select("label").distinct().count() < 2:
        return Model(confident=cfg.confident)
    fitted = GBTClassifier(maxIter=cfg.trees, maxDepth=cfg.depth, stepSize=0.3, minInstancesPerNode=5, seed=7).fit(fit.coalesce(4).select(array_to_vector("x").alias("features"), "label"))
    trees = [_exported(t._java_obj.rootNode()) if hasattr(t, "_java_obj") else _exported(t._call_java("rootNode")) for t in fitted.trees]
    model = Model(trees, [float(w) for w in fitted.treeWeights], 0.0, 1.0, cfg.confident)
    rows = held.select("x", "label").collect()  # a quarter of the bounded sample
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    margin = sum(w * _walk(t, x) for t, w in zip(model.trees, model.weights, strict=True))
    bias, slope = calibration(margin, y)
    return Model(model.trees, model.weights, float(bias), float(slope), cfg.confident)


def selected(text: str | None, model: Model) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, from the base rules) of one text, by kind, then start. Added spans overlap neither base spans nor each
    other: the likeliest comes first, then the longest."""
    if not text or not _ANY.search(text):
        return []
    base = base_spans(text)
    more = [p for p in proposals(text) if not any(s < p[2] and p[1] < t for _, s, t in base)] if model.trees else []
    added: list[tuple[int, int, int, bool]] = []
    if more:
        chance = model.probability(np.array([features(text, *p) for p in more]))
        for c, (kind, b, e) in sorted(zip(chance.tolist(), more, strict=True), key=lambda z: (-z[0], z[1][1] - z[1][2], z[1])):
            if c < model.confident:
                break
            if not any(s < e and b < t for _, s, t, _ in added):
                added.append((kind, b, e, False))
    return sorted([(*s, True) for s in base] + added)


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for k, b, e, *_ in spans)


def detect(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row: counts and digest of the base spans, and all
    selected spans. Null texts are empty; an empty text has no spans. Rows that repeat are judged each."""
    schema = f"`{id_column}` long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    names = [id_column, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches):
        for batch in batches:
            found = [selected(t.as_py(), model) for t in batch.column(1)]
            base = [[s for s in spans if s[3]] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(4)],
                 pa.array([hashlib.sha256(_written(spans).encode()).hexdigest() for spans in base]), pa.array([_written(s) for s in found], pa.string()),
                 pa.array([len(s) - len(b) for s, b in zip(found, base, strict=True)], pa.int64())],
                names=names,
            )

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).mapInArrow(run, schema)


def redacted(text: str | None, model: Model) -> str | None:
    """The text with every selected span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    spans = sorted((b, -e, k) for k, b, e, _ in selected(text, model))
    if not spans:
        return text
    out, at = [], 0
    for b, end, k in spans:
        if b >= at:
            out += [text[at:b], f"[{KINDS[k].upper()}]"]
        at = max(at, -end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """`docs` with spans replaced in its text column; all other columns are carried as they are."""
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            texts = pa.array([redacted(t.as_py(), model) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.withColumn(text_column, F.col(f"`{text_column}`").cast("string")).mapInArrow(run, docs.withColumn(text_column, F.col(f"`{text_column}`").cast("string")).schema)
