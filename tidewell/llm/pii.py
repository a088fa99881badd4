"""Personal data: pattern matches, and further spans by a semi-Markov conditional random field.

The patterns find what is written the usual way. The field adds spelled variants of the same
kinds (numbers without their plus sign, other separators, bracketed "at" and "dot"). It scores
whole candidate segments: their shape, marks, digit count, check digit, octets, host and borders. A
dynamic program over segments of at most ``MAX_TOKENS`` tokens chooses borders and kinds of a window
jointly. Only segments with an anchor (a digit, or a bracketed "at") can be an entity, and none
crosses a line end, so that windows of ``MAX_TOKENS`` tokens around the anchors of a line decode the
whole text exactly; a span of more tokens is out of reach.

Weights are learnt by maximum likelihood from a bounded sample of windows: pattern matches give
silver spans, as they stand and respelled, and everything else in a window is outside.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import broadcasted, sliced, table, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest candidate segment.
MAX_TOKENS = 24
#: Bound of the training sample: documents drawn by the lowest hash of their id, and windows drawn likewise of all of theirs.
SAMPLE_DOCS, SAMPLE_WINDOWS = 1000, 900
#: Documents drawn before those with digits are picked out of them.
DRAWN_DOCS = 8000
#: Characters on both sides of a match in a training window.
MARGIN = 60
EPOCHS, RATE, DECAY = 6, 0.4, 1e-3

_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_ANCHOR = re.compile(r"[0-9]+|[(\[{] ?(?:at|AT) ?[)\]}]")
_BRACKETED = re.compile(r"[(\[{] ?(at|AT|dot|DOT) ?[)\]}]")
_MARK_BEHIND, _MARK_BEFORE = re.compile(r" ?[(\[{] ?(?:at|AT|dot|DOT) ?[)\]}]"), re.compile(r"[(\[{] ?(?:at|AT|dot|DOT) ?[)\]}] ?$")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(doubled[int(d)]) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _AFTER_AT.match(text, at) if start < at else None
        if match:
            yield Span("email", start, match.end())
        done = match.end() if match else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and non-overlapping within a kind, by kind and start.

    Written so that each takes time in proportion to the text, however it is built.
    """
    spans = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            spans.append(Span("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(Span("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(Span("phone", *m.span()))
    return spans


class Window(NamedTuple):
    """A part of a text around anchors: token borders (offsets in the text) and candidate segments."""

    borders: list[int]
    segments: list[tuple[int, int, list[int], list[str]]]


def _plain(part: str) -> str:
    return _BRACKETED.sub(lambda m: "@" if m.group(1).lower() == "at" else ".", part)


_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+")


def possible_kinds(plain: str) -> list[int]:
    """Kinds that a segment (bracketed marks written plainly) may have: an address has one word before its "at" and a
    dot and one word at its end; with other letters than an address's there is no other kind. An ip has four groups
    of digits, a card 13 to 19 digits, a phone number 7 to 15. What it takes beyond that, the weights tell."""
    if "@" in plain[1:-1]:
        local, _, host = plain.partition("@")
        return [0] if "." in host[:-1] and " " not in local.rstrip() and " " not in host[host.rindex(".", 0, -1) + 1 :].strip() else []
    if any(c.isalpha() for c in plain):
        return []
    n = sum(c.isdigit() for c in plain)
    kinds = [1] if 4 <= n <= 12 and len(re.findall("[0-9]+", plain)) == 4 else []
    return kinds + [2] * (13 <= n <= 19) + [3] * (7 <= n <= 15)


def segment_features(text: str, start: int, end: int, plain: str) -> list[str]:
    """Features of a whole segment; ``plain`` is it with bracketed marks written plainly."""
    part = text[start:end]
    shape = re.sub("[0-9]+", lambda m: f"<{len(m.group())}>", re.sub(r"[^\W\d_]+", "a", plain))
    marks = "".join(sorted(set(re.sub(r"[\w]", "", part))))
    edge = lambda c: "a" if c.isalpha() else "9" if c.isdigit() else c
    before, after = text[start - 1 : start], text[end : end + 1]
    groups = re.findall("[0-9]+", plain)
    digits = "".join(groups)
    out = ["any", f"marks {marks}", f"first {edge(part[0])}", f"last {edge(part[-1])}"]
    if "@" in plain:
        out.append(f"address {bool(_ADDRESS.fullmatch(plain))} {'@' in part}")
    else:
        out += [f"shape {shape}", f"digits {len(digits)}", f"groups {min(len(groups), 8)}", f"check {luhn(digits)} {len(digits) > 15}", f"octets {all(len(g) < 4 and int(g) < 256 for g in groups)} {'.' in part}", f"unusual {bool(re.search(r'[^ ().+/0-9-]', part))}"]
    if before and before in "+@.-(_" or after and after in "@-_" or re.match(r"[.@]\w", text[end : end + 2]) or _MARK_BEHIND.match(text, end) or _MARK_BEFORE.search(text, max(0, start - 9), start):
        out.append("torn")
    return out


def _inside_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def windows(text: str) -> Iterator[Window]:
    """Windows of a text with their candidate segments. Segments start and end at visible tokens
    and not inside a word, hold an anchor and no line end. Anchors of a line with fewer than twice
    ``MAX_TOKENS`` tokens between them share a window."""
    line_end = -1
    for first in _ANCHOR.finditer(text):
        if first.start() < line_end:
            continue
        line_start = text.rfind("\n", 0, first.start()) + 1
        line_end = text.find("\n", first.start())
        line_end = len(text) if line_end < 0 else line_end
        borders = [m.start() for m in _TOKEN.finditer(text, line_start, line_end)] + [line_end]
        group: list[tuple[int, int]] = []  # token ranges of anchors
        for m in _ANCHOR.finditer(text, first.start(), line_end):
            at = bisect_left(borders, m.start()), bisect_left(borders, m.end())
            if group and at[0] - group[-1][1] >= 2 * MAX_TOKENS:
                yield _window(text, borders, group)
                group = []
            group.append(at)
        yield _window(text, borders, group)


def _window(text: str, borders: list[int], anchors: list[tuple[int, int]]) -> Window:
    left, right = max(0, anchors[0][0] - MAX_TOKENS), min(len(borders) - 1, anchors[-1][1] + MAX_TOKENS)
    segments = []
    nearest = 0
    for i in range(left, anchors[-1][0] + 1):
        while anchors[nearest][0] < i:
            nearest += 1
        s = borders[i]
        if anchors[nearest][1] - i > MAX_TOKENS or text[s].isspace() or _inside_word(text, s):
            continue
        for j in range(anchors[nearest][1], min(i + MAX_TOKENS, right) + 1):
            e = borders[j]
            if not text[e - 1].isspace() and not _inside_word(text, e):
                plain = _plain(text[s:e])
                if kinds := possible_kinds(plain):
                    segments.append((i - left, j - left, kinds, segment_features(text, s, e, plain)))
    return Window(borders[left : right + 1], segments)


class SemiCrf:
    """Weights of segment features for each kind; a token outside scores 0."""

    def __init__(self, features: dict[str, int], weights: np.ndarray):
        self.features, self.weights = features, weights

    def scores(self, window: Window) -> list[np.ndarray]:
        """Of each segment, one for each kind that it can have."""
        known = self.features
        return [self.weights[np.ix_(kinds, [known[f] for f in names if f in known])].sum(1) for _, _, kinds, names in window.segments]

    def decode(self, window: Window) -> list[Span]:
        """The best segmentation: offsets and kinds of its entities."""
        n = len(window.borders) - 1
        ending: dict[int, list[tuple[int, float, int]]] = {}
        for (i, j, kinds, _), score in zip(window.segments, self.scores(window), strict=True):
            top = int(score.argmax())
            if score[top] > 0:
                ending.setdefault(j, []).append((i, float(score[top]), kinds[top]))
        value, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
        for j in range(1, n + 1):
            value[j], back[j] = value[j - 1], (j - 1, -1)
            for i, score, kind in ending.get(j, ()):
                if value[i] + score > value[j]:
                    value[j], back[j] = value[i] + score, (i, kind)
        spans, j = [], n
        while j > 0:
            i, kind = back[j]
            if kind >= 0:
                spans.append(Span(KINDS[kind], window.borders[i], window.borders[j]))
            j = i
        return spans[::-1]

    def spans(self, text: str) -> list[Span]:
        return [s for w in windows(text) for s in self.decode(w)]


def _log_sum(values: np.ndarray) -> float:
    top = values.max()
    return float(top + np.log(np.exp(values - top).sum()))


def train(examples: list[tuple[str, list[Span]]], seed: int = 0) -> SemiCrf:
    """Maximum likelihood by stochastic gradients over forward and backward sums of segmentations."""
    data = []
    features: dict[str, int] = {}
    for text, gold in examples:
        at = {(s.start, s.end): KINDS.index(s.kind) for s in gold}
        for window in windows(text):
            if window.segments:
                data.append((window, [at.get((window.borders[i], window.borders[j]), -1) for i, j, _, _ in window.segments]))
                for _, _, _, names in window.segments:
                    for name in names:
                        features.setdefault(name, len(features))
    weights = np.zeros((len(KINDS), len(features)))
    model = SemiCrf(features, weights)
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 2)
        for k in rng.permutation(len(data)).tolist():
            window, gold = data[k]
            n = len(window.borders) - 1
            scores = model.scores(window)
            total = [_log_sum(s) for s in scores]
            forward, backward = np.zeros(n + 1), np.zeros(n + 1)
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for at, (i, j, _, _) in enumerate(window.segments):
                by_end.setdefault(j, []).append(at)
                by_start.setdefault(i, []).append(at)
            for j in range(1, n + 1):
                forward[j] = forward[j - 1] if j not in by_end else _log_sum(np.array([forward[j - 1], *(forward[window.segments[at][0]] + total[at] for at in by_end[j])]))
            for i in range(n - 1, -1, -1):
                backward[i] = backward[i + 1] if i not in by_start else _log_sum(np.array([backward[i + 1], *(backward[window.segments[at][1]] + total[at] for at in by_start[i])]))
            for (i, j, kinds, names), score, right in zip(window.segments, scores, gold, strict=True):
                step = -np.exp(np.minimum(forward[i] + score + backward[j] - forward[n], 0))
                if right in kinds:
                    step[kinds.index(right)] += 1
                cells = np.ix_(kinds, [features[f] for f in names])
                weights[cells] += rate * (step[:, None] - DECAY * weights[cells])
    return model


def respelled(span: Span, part: str, turn: int) -> str:
    """Another spelling of a match, by turns."""
    if span.kind == "email":
        at, dot = (("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", " (dot) "))[turn % 3]
        local, _, host = part.partition("@")
        return local + at + host.replace(".", dot)
    digits = re.sub("[^0-9]", "", part)
    if span.kind == "card":
        return (".", " - ", "/")[turn % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if span.kind == "phone":
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}")[turn % 4]
    return part.replace(".", ("[.]", " . ", "(.)")[turn % 3])


def training_examples(text: str) -> list[tuple[str, list[Span]]]:
    """Windows of a text around matches as they stand, the same with the match respelled, and one window without any."""
    out: list[tuple[str, list[Span]]] = []
    base = base_spans(text)
    for turn, s in enumerate(sorted(base, key=lambda s: (s.start, s.kind))):
        left, right = max(0, s.start - MARGIN), s.end + MARGIN
        inside = [Span(b.kind, b.start - left, b.end - left) for b in base if b.start >= left and b.end <= right]
        out.append((text[left:right], inside))
        if any(b is not s and b.start < s.end and s.start < b.end for b in base):
            continue
        # the same window with this match respelled: what stands behind it moves
        new = respelled(s, text[s.start : s.end], turn + s.start)
        moved = len(new) - (s.end - s.start)
        others = [Span(b.kind, b.start + moved * (b.start >= s.end), b.end + moved * (b.start >= s.end)) for b in inside if b.start + left != s.start]
        out.append((text[left : s.start] + new + text[s.end : right], [*others, Span(s.kind, s.start - left, s.start - left + len(new))]))
    for m in _ANCHOR.finditer(text):
        if not any(s.start - 80 < m.end() and m.start() < s.end + 80 for s in base):
            out.append((text[max(0, m.start() - MARGIN) : m.end() + MARGIN], []))
            break
    return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SemiCrf:
    """Learns from ``SAMPLE_WINDOWS`` windows at most, drawn by hash from all windows of ``SAMPLE_DOCS`` documents with
    digits, which are drawn by the hash of their id. What reaches the driver has the bound of the draw."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, at, t, written(spans)) for h, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True) for at, (t, spans) in enumerate(training_examples(text))]
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:])], ["h", "at", "text", "spans"])

    key = F.col(id_col).cast("long")
    share = max(1, df.count() // DRAWN_DOCS)
    drawn = df.where(F.pmod(F.xxhash64(key, F.lit("draw")), F.lit(share)) == 0)
    texts = drawn.select(F.xxhash64(key, F.lit(5)).alias("h"), F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike(r"\+[0-9]|@[a-z]|[0-9]{3}"))
    found = texts.orderBy("h", "t").limit(SAMPLE_DOCS).mapInArrow(examples, "h long, at int, text string, spans string")
    rows = found.orderBy(F.xxhash64("h", "at"), "text", "spans").limit(SAMPLE_WINDOWS).collect()
    return train([(r["text"], [Span(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]) for r in rows])


def all_spans(text: str, model: SemiCrf) -> tuple[list[Span], list[Span]]:
    """(pattern matches, those and what the field adds where no match lies), by kind and start."""
    base = base_spans(text)
    taken = sorted((s.start, s.end) for s in base)
    reach = list(accumulate((end for _, end in taken), max))
    # matches that start before the end of s, of which one ends behind its start
    free = lambda s: not (n := bisect_left(taken, (s.end,))) or reach[n - 1] <= s.start
    added = [s for s in model.spans(text) if free(s)]
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s.kind), s.start))


def written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (pattern matches), base_sha256 and spans of every row.

    A null text counts as empty and has no span. Every row gives one row, repeated ones and those
    without an id included; other columns are not read; an empty table gives an empty one.
    """
    model = broadcasted(df.sparkSession, fit(df, id_col, text_col))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cols: list[list] = [[] for _ in range(6)]
            for text in texts_of(batch.column(1)):
                base, spans = all_spans(text, model.value)
                for col, kind in zip(cols, KINDS, strict=False):
                    col.append(sum(s.kind == kind for s in base))
                cols[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                cols[5].append(written(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t.type) for c, t in zip(cols, list(_OUT)[1:], strict=True))], schema=_OUT)

    chosen = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first
    names the whole stretch."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced; all columns stay, null texts stay null."""
    model = broadcasted(df.sparkSession, fit(df, id_col, text_col))
    at = df.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            clean = [None if t is None else redacted(t, all_spans(t, model.value)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return df.mapInArrow(rows, df.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
