"""Personal data: generators propose spans, boosted trees weigh them, calibrated thresholds select.

Checked patterns (address shapes, checksums, ranges) are always reported; the trees add
spans that no checked pattern covers. What labels the training spans (checks, words that
announce a kind) is no feature of the trees.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import boost
from eventloom.llm.common import small_batches, whole_text, written

#: The kinds in the order in which spans with equal starts are listed; the first four have checked patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Parameters: candidates of a kind that the trees are fitted on, one in how many is held out, precision that a threshold must reach there, right ones needed to tell it.
SAMPLE = 20_000
HELD_OUT = 4
PRECISION = 0.98
LEAST_HELD_OUT = 10
#: Fixed value: bins of a score's log odds per unit.
BINS = 50

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is consumed as a whole, so that a match can only begin where a run does.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Each match of a checked pattern or generator has one of these.
WORTH_A_LOOK = re.compile(r"[0-9@]|[(\[]at[)\]]|eyJ")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, from each @ to both sides: the time is linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def checked(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans of the checked patterns, in order; end exclusive, in code points."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


#: The generators: shapes that may be personal data, each with the kind that it proposes. They overlap freely.
GENERATORS = (
    (0, re.compile(r"(?<![^\s<(\"'])[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[\w-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,64})+")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{2,6}(?:[ .-]?[0-9]{2,6}){2,6}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])[+(]?[0-9]{1,4}[ ().-]{0,2}[0-9]{2,4}(?:[ ).-]{1,2}[0-9]{2,4}){1,3}(?![0-9])")),
    (4, re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+")),
    (4, re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]{10,}+){1,4}+(?![A-Za-z0-9_-])")),
)
#: Well-known forms of secrets: signed web tokens and keys with a service's prefix.
KNOWN_SECRET = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)?|A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[A-Za-z0-9_-]{20,}")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
CARD_GROUPS = re.compile(r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ .-])[0-9]{6}\2[0-9]{5}")
DATE = re.compile(r"(?:[0-9]{4}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-][0-9]{4})(?:[ .-].*)?")
ASSIGNED = re.compile(r"(?i)(?:token|api.?key|secret|passw(?:or)?d|access.?key)\W{0,3}[=:]\W{0,3}$")
CONTEXT = tuple(re.compile(p) for p in (r"(?i)(?:mail|contact)\W*\w{0,10}\W*$", r"(?i)(?:\bip|host|server|addr)\w*\W*$", r"(?i)(?:card|visa|credit|account)\w*\W*\w{0,8}\W*$", r"(?i)(?:phone|tel|call|mobile|fax)\w*\W*\w{0,8}\W*$", r"(?i)(?:token|key|secret|passw)\w*\W*$"))


def plain_address(span: str) -> str:
    """An address with (at), [dot] and the like undone."""
    return re.sub(r" ?(?:\(dot\)|\[dot\]|\.) ?", ".", re.sub(r" ?(?:\(at\)|\[at\]|@) ?", "@", span))


def well_formed(span: str, kind: int) -> bool:
    """Whether a proposed span passes its kind's check, once obfuscation and separators are undone; whatever stands around it."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        return bool(ADDRESS.fullmatch(plain_address(span)))
    if kind == 1:
        return all(int(p) <= 255 for p in span.split("."))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 7 <= len(digits) <= 15 and not DATE.fullmatch(span) and not re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", span)
    return bool(KNOWN_SECRET.fullmatch(span))


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a proposed span, as numbers.

    What labels are made of stays out: no checksum, no range, no word before the span.
    """
    span, before, after = text[start:end], text[max(0, start - 4) : start], text[end : end + 1]
    groups = re.findall("[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    digits, letters = sum(sizes), sum(c.isalpha() for c in span)
    parts = [len(p) for p in span.split(".")]
    lead = re.match("[a-z]*[A-Z]*", span)[0]
    opening = re.search(r"[=:]\W*$", before)
    return [
        kind,
        len(span),
        digits,
        digits / len(span),
        letters / len(span),
        (len(span) - digits - letters) / len(span),
        len(groups),
        max(sizes),
        min(sizes),
        sizes[0],
        sizes[-1],
        len(parts) - 1,
        max(parts),
        min(parts),
        len(lead),
        sum(c.isupper() for c in lead),
        span.count("_"),
        span.count("-"),
        span.count(" "),
        span.count("/"),
        span.count("@"),
        sum(span.count(c) for c in "([") + before[-1:].count("("),
        float(span.startswith("+") or before.endswith("+")),
        len(set(span)) / len(span),
        sum(c in "0123456789abcdef" for c in span) / len(span),
        sum(c.isupper() for c in span) / len(span),
        sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:])) / len(span),
        float(before[-1:].isalnum()),
        float(before[-1:] in ("", "\n")),
        float(before[-1:] in ("'", '"', "`")),
        float(bool(opening)),
        float(after.isalnum()),
        float(after in ("'", '"', "`")),
    ]


def proposed(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the generators find; secrets have a digit or a well-known form."""
    found = [(m.start(), kind, m.end()) for kind, shape in GENERATORS for m in shape.finditer(text)]
    return [s for s in found if s[1] != 4 or re.search("[0-9]", text[s[0] : s[2]]) or KNOWN_SECRET.fullmatch(text, s[0], s[2])]


def eligible(text: str) -> list[tuple[int, int, int]]:
    """The proposed spans but those that a check refutes; these only serve the trees as counterexamples."""
    return [s for s in proposed(text) if s[1] == KINDS.index("secret") or well_formed(text[s[0] : s[2]], s[1])]


class Covered:
    """The checked spans of a text by kind, for lookups."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}
        for a, kind, b in sorted(base):  # spans of one kind don't overlap
            self.starts.setdefault(kind, []).append(a)
            self.ends.setdefault(kind, []).append(b)

    def __contains__(self, span: tuple[int, int, int]) -> bool:
        start, kind, end = span
        k = bisect_right(self.starts.get(kind, []), start) - 1
        return k >= 0 and end <= self.ends[kind][k]


def weak_label(text: str, span: tuple[int, int, int], base: Covered) -> float | None:
    """1 for spans that a check confirms, 0 for those that it refutes, None where it can't tell.

    Confirmed are spans inside a checked pattern; well-formed ones, once obfuscation and
    separators are undone, with a sign of their kind (an address with (at) or behind a word
    for mail, a card in the groups of cards or behind a word for cards, a phone number
    behind a word for phones); and secrets of a well-known form or assigned to a secret's
    name. Refuted are spans that aren't well-formed, and other secrets. The words and
    checks that say so are no features, so the trees learn what confirmed spans look like
    and find those that no word announces.
    """
    start, kind, end = span
    before, own = text[max(0, start - 24) : start], text[start:end]
    if kind == KINDS.index("secret"):
        return float(well_formed(own, kind) or bool(ASSIGNED.search(before)))
    if span in base:
        return 1.0
    if not well_formed(own, kind):
        return 0.0
    sign = CONTEXT[kind].search(before) or (kind == 0 and re.search(r"[(\[]at[)\]]", own)) or (kind == 2 and CARD_GROUPS.fullmatch(own))
    return 1.0 if sign else None


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All documents' distinct labelled candidates: h (a hash of the span with its surroundings, features and label), kind, x, y.

    Copies count once, wherever they stand, and a quarter of the hashes is held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, at = [], [], []
            for text in batch.column("text").to_pylist():
                if WORTH_A_LOOK.search(text):
                    base = Covered(checked(text))
                    for span in proposed(text):
                        y, (start, kind, end) = weak_label(text, span, base), span
                        if y is None:
                            continue
                        x = features(text, kind, start, end)
                        rows.append(x)
                        labels.append(y)
                        what = f"{x}{y}{text[max(0, start - 40) : start]}\0{text[start:end]}\0{text[end : end + 40]}"
                        at.append(int.from_bytes(hashlib.blake2b(what.encode(errors="replace"), digest_size=8).digest(), "big") >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([int(x[0]) for x in rows], pa.int32()), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], names=["h", "kind", "x", "y"])

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "h long, kind int, x array<double>, y double").dropDuplicates(["h"])


def limit_of(bins: np.ndarray, right: np.ndarray, n: np.ndarray) -> float:
    """A kind's threshold, from its held-out candidates by bin of their score: those that are right, and all.

    It is the least score, 0.5 at least, from which on candidates are right in PRECISION
    of the cases, and 2 (no span) if there is none. With fewer than LEAST_HELD_OUT right
    ones that share can't be told; the least score from which on none is wrong counts then.
    """
    order = np.argsort(-bins)
    bins, right, n = bins[order], np.cumsum(right[order]), np.cumsum(n[order])
    rare = not len(n) or right[-1] < LEAST_HELD_OUT
    if rare:
        wrong = bins[right < n]
        return 1 / (1 + np.exp(-max((wrong[0] + 1) / BINS if len(wrong) else 0, 0)))
    good = np.flatnonzero((right >= PRECISION * n) & (right >= LEAST_HELD_OUT))
    if not len(good):
        return 2.0
    lower = (bins[good[-1] + 1 :] >= 0).any()  # else all from 0.5 on are right enough
    return 1 / (1 + np.exp(-max(bins[good[-1]] / BINS, 0))) if lower else 0.5


def fitted(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, tuple[int, float, float]]]:
    """The trees and the thresholds by kind, from candidates with weak labels; and by kind the held-out confirmed spans, precision and recall.

    All documents give candidates. The trees see of each kind about `sample` of those that
    aren't held out, half of each label if there are as many, by the smallest hashes, so
    that the sample is the same in each run. Thresholds come from all that are held out,
    as counts by kind and score.
    """
    found = written(candidates(docs, text_col), "pii-candidates")
    fit = found.filter(F.col("h") % HELD_OUT != 0)
    few = F.lit(False)
    for kind, label, n in fit.groupBy("kind", "y").count().collect():
        few |= (F.col("kind") == kind) & (F.col("y") == label) & (F.col("h") <= min((1 << 63) - 1, (1 << 63) * (sample // 2) // n))
    rows = fit.filter(few).select("h", "x", "y").toArrow()
    h = rows["h"].to_numpy().astype(np.int64)
    width = len(features("0", 0, 0, 1))
    x, y = np.array(rows["x"].to_pylist(), float).reshape(len(h), width), rows["y"].to_numpy().astype(float)
    order = np.argsort(h)
    model = boost.fit(x[order], y[order])
    learned = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = boost.predict(learned.value, np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, width))
            bins = np.floor(np.clip(np.log(p / np.maximum(1 - p, 1e-300)), -30, 30) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(bins), batch.column("y")], names=["kind", "bin", "y"])

    held = found.filter(F.col("h") % HELD_OUT == 0).select("kind", "x", "y").mapInArrow(score, "kind int, bin int, y double")
    counts = np.array([tuple(r) for r in held.groupBy("kind", "bin").agg(F.sum("y"), F.count("*")).collect()], float).reshape(-1, 4)
    limits = np.array([limit_of(*counts[counts[:, 0] == kind, 1:].T) for kind in range(len(KINDS))])
    figures = {}
    for kind, name in enumerate(KINDS):
        bins, right, n = counts[counts[:, 0] == kind, 1:].T
        over = bins >= np.log(limits[kind] / (1 - limits[kind])) * BINS - 1e-6 if limits[kind] < 1 else np.zeros(len(bins), bool)
        figures[name] = int(right.sum()), right[over].sum() / max(n[over].sum(), 1), right[over].sum() / max(right.sum(), 1)
    return model, limits, figures


def selected(size: int, base: list[tuple[int, int, int]], spans: list[tuple[int, int, int]], scores: np.ndarray, limits: np.ndarray) -> list[tuple[int, int, int]]:
    """base and, the best-scored first, the proposed spans over their threshold that overlap nothing taken before.

    Equal scores go by start, then kind, then the longer one. size is the text's length:
    taken places are marked, so the time is linear in the text and its spans.
    """
    taken, marks = list(base), bytearray(size)
    for a, _, b in base:
        marks[a:b] = b"\1" * (b - a)
    own = np.array(spans, np.int64).reshape(-1, 3)
    for k in np.lexsort((-own[:, 2], own[:, 1], own[:, 0], -scores)):
        a, kind, b = spans[k]
        if scores[k] >= limits[kind] and marks.find(1, a, b) < 0:
            marks[a:b] = b"\1" * (b - a)
            taken.append(spans[k])
    return sorted(taken)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base_spans and spans (arrays of start, kind, end, in code points, end exclusive).

    base_spans are the checked patterns' matches in the whole text, leftmost and not
    overlapping within a kind; spans adds what the trees select. Null and empty texts
    have none; repeated rows have equal results; an empty table gives an empty result
    and other columns are not read. Documents are read once for the candidates, of which
    the distinct ones are shuffled as narrow rows, and once for the spans.
    """
    spark = docs.sparkSession
    small_batches(spark)
    learned = spark.sparkContext.broadcast(fitted(docs, text_col)[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = learned.value
        as_rows = lambda spans: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans]
        type_ = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [checked(t) if WORTH_A_LOOK.search(t) else [] for t in texts]
            spans = [eligible(t) if WORTH_A_LOOK.search(t) else [] for t in texts]
            rows = [features(t, s[1], s[0], s[2]) for t, own in zip(texts, spans) for s in own]
            scores = boost.predict(model, np.array(rows, float)) if rows else np.zeros(0)
            parts = np.split(scores, np.cumsum([len(s) for s in spans])[:-1]) if texts else []
            final = [selected(len(t), b, s, p, limits) if s else b for t, b, s, p in zip(texts, base, spans, parts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([as_rows(b) for b in base], type_), pa.array([as_rows(s) for s in final], type_)], names=["doc_id", "base_spans", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    span = "array<struct<start:int,kind:string,end:int>>"
    return rows.mapInArrow(run, f"doc_id long, base_spans {span}, spans {span}")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans are replaced together."""
    out, last = [], 0
    for a, kind, b in spans:
        if a >= last:
            out += [text[last:a], f"<{KINDS[kind]}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])
