"""Personal data: base patterns, and a tagger that adds spans to theirs.

The tagger is a character-level bidirectional LSTM with CRF transitions (`crf_tagger`), trained on
spans that the base patterns label in a bounded sample of windows. A span holds an "@" or a digit
by definition of the kinds, so windows without either are not scored: their only path is no span.
Windows overlap by half; of what they decode, spans cut by a window's edge are left to the neighbour
that holds them whole, and the rest is reconciled over the text: surest first, none overlapping a
base span or a surer one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homespell.llm import store
from homespell.llm.crf_tagger import Tagger, encode
from homespell.llm.text import lowest, map_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Windows that the tagger is trained on at most: those of the lowest hash.
SAMPLE_WINDOWS = 3000
STEPS, BATCH, RATE = 200, 96, 0.02
#: Least mean posterior of a span that the tagger adds.
SURE = 0.98
#: Characters without one of which no span exists.
TRIGGER = "[0-9@]"

#: Tags: 0 outside, then first and further characters of each kind.
TAGS = 1 + 2 * len(KINDS)
_MASKS = tuple(f"[{kind.upper()}]" for kind in KINDS)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(TRIGGER)

Span = tuple[int, int, int]  # kind, start, end


def _luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if at % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored on each "@", so that long runs without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that fail its check dropped."""
    spans = [(0, start, end) for start, end in _emails(text)]
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.group().split(".")):
            spans.append((1, *match.span()))
    for match in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", match.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, *match.span()))
    for match in _PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", match.group())) <= 15:
            spans.append((3, *match.span()))
    return sorted(spans, key=lambda span: (span[1], span[0], span[2]))


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold an "@" or a digit; together they hold every such character
    and, but for the ends of the text, hold it twice."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE)) if len(text) > WINDOW else 0
    slots: set[int] = set()
    for match in _TRIGGER.finditer(text):
        slot = match.start() // STRIDE
        slots.update((slot - 1, slot))
    return sorted({min(max(slot, 0), last) * STRIDE for slot in slots})


def tags_of(spans: list[Span], start: int, length: int) -> np.ndarray:
    """Tags of a window; the longer of overlapping spans wins."""
    tags = np.zeros(length, np.int8)
    for kind, low, high in sorted(spans, key=lambda span: (span[2] - span[1], -span[0])):
        first, end = max(low - start, 0), min(high - start, length)
        if first < end:
            tags[first:end] = 2 + 2 * kind
            if low >= start:
                tags[first] = 1 + 2 * kind
    return tags


def padded(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.zeros((len(windows), WINDOW), np.int64)
    mask = np.zeros((len(windows), WINDOW), bool)
    for row, window in enumerate(windows):
        codes[row, :len(window)] = encode(window)
        mask[row, :len(window)] = True
    return codes, mask


def decoded_spans(path: np.ndarray, sure: np.ndarray, length: int, start: int, size: int) -> list[tuple[float, Span]]:
    """Spans of one window with their mean posterior, without those that its edge may cut."""
    found, at = [], 0
    while at < length:
        tag = int(path[at])
        if not tag:
            at += 1
            continue
        kind, end = (tag - 1) // 2, at + 1
        while end < length and path[end] == 2 + 2 * kind:
            end += 1
        cut = (at == 0 and start > 0) or (end == length and start + length < size)
        if not cut:
            found.append((float(sure[at:end].mean()), (kind, start + at, start + end)))
        at = end
    return found


def plausible(kind: int, piece: str) -> bool:
    """What the kinds demand of any span: an "@" between word characters, or enough digits."""
    digits = sum("0" <= c <= "9" for c in piece)
    if piece != piece.strip():
        return False
    return (bool(re.fullmatch(r"[^@\s]+@[^@\s]+", piece)), piece.count(".") >= 3 and digits >= 4, 12 <= digits <= 19, 9 <= digits <= 15)[kind]


def reconcile(text: str, base: list[Span], decoded: list[tuple[float, Span]]) -> list[Span]:
    """Base spans and the surest others that overlap nothing chosen before."""
    taken = np.zeros(len(text) + 1, bool)
    for _, start, end in base:
        taken[start:end] = True
    added = []
    for sure, (kind, start, end) in sorted(set(decoded), key=lambda x: (-x[0], x[1][1], x[1][0], x[1][2])):
        if sure >= SURE and not taken[start:end].any() and plausible(kind, text[start:end]):
            taken[start:end] = True
            added.append((kind, start, end))
    return sorted([*base, *added], key=lambda span: (span[1], span[0], span[2]))


def _text() -> Column:
    return F.col("text").cast("string")


def _sample_windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    windows, tags = [], []
    for text in batch.column("text").to_pylist():
        spans = base_spans(text)
        for start in window_starts(text):
            windows.append(text[start:start + WINDOW])
            tags.append(tags_of(spans, start, len(windows[-1])).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(tags, pa.binary())], names=["piece", "tags"])


def train(docs: DataFrame, sample_windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """A tagger from base spans in the distinct windows of lowest hash; None without any window."""
    triggered = docs.select(_text().alias("text")).where(F.col("text").rlike(TRIGGER))
    # Copies go before the sample is taken, or those of one window could fill it.
    labelled = store.save(map_batches(triggered, _sample_windows, "piece string, tags binary").dropDuplicates(["piece", "tags"]), "windows")
    windows = lowest(labelled, sample_windows, F.xxhash64("piece"), "piece", "tags").collect()
    store.discard(labelled)
    if not windows:
        return None
    rows = {(row.piece, bytes(row.tags)) for row in windows}
    codes, mask = padded([piece for piece, _ in sorted(rows)])
    tags = np.zeros(codes.shape, np.int64)
    for at, (_, own) in enumerate(sorted(rows)):
        tags[at, :len(own)] = np.frombuffer(own, np.int8)
    tagger = Tagger(TAGS)
    tagger.train(codes, mask, tags, STEPS, BATCH, RATE)
    return tagger


def find_all(texts: list[str | None], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; the windows of all texts are decoded together."""
    base = [base_spans(text) if text else [] for text in texts]
    decoded: list[list[tuple[float, Span]]] = [[] for _ in texts]

    def flush(waiting: list[tuple[int, int]]) -> None:
        pieces = [texts[row][start:start + WINDOW] for row, start in waiting]
        paths, sure = tagger.decode(*padded(pieces))
        for (row, start), piece, path, own in zip(waiting, pieces, paths, sure):
            decoded[row].extend(decoded_spans(path, own, len(piece), start, len(texts[row])))

    if tagger is not None:
        waiting: list[tuple[int, int]] = []
        for row, text in enumerate(texts):
            for start in window_starts(text) if text else ():
                waiting.append((row, start))
                if len(waiting) == 1024:
                    flush(waiting)
                    waiting = []
        if waiting:
            flush(waiting)
    return [(own, reconcile(text or "", own, more) if more else own) for text, own, more in zip(texts, base, decoded)]


def personal_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of each row of ``docs``.

    Counts and hash are of the base spans, ``spans`` lists all. Needs doc_id and text; a null or empty
    text has no spans; repeated rows are reported each. Texts that hold neither "@" nor a digit do
    not leave the JVM.
    """
    tagger = train(docs)

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find_all(batch.column("text").to_pylist(), tagger)
        counts = [[sum(span[0] == kind for span in base) for base, _ in found] for kind in range(len(KINDS))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
             pa.array([hashlib.sha256(spell(base).encode()).hexdigest() for base, _ in found]),
             pa.array([spell(spans) for _, spans in found]), pa.array([len(spans) - len(base) for base, spans in found], pa.int64())],
            names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(_text().rlike(TRIGGER), _text()).alias("text"))
    return map_batches(rows, search, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_spans(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one replacement."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], _MASKS[kind]]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by its kind, and n_chars (where present) to match.

    Null and empty texts stay as they are, repeated rows each, rows without doc_id too; an empty table gives no rows. Other
    columns are passed on.
    """
    tagger = train(docs)
    kind = dict(docs.dtypes)
    trigger = F.coalesce(_text().rlike(TRIGGER), F.lit(False))

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("text").to_pylist()
        masked = pa.array([mask_spans(text, spans) if spans else text for text, (_, spans) in zip(own, find_all(own, tagger))], batch.schema.field("text").type)
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field("text"), masked)

    masked = map_batches(docs.where(trigger), search, docs.schema)
    if "n_chars" in kind:
        masked = masked.withColumn("n_chars", F.length("text").cast(kind["n_chars"])).select(*docs.columns)
    return docs.where(~trigger).unionByName(masked)
