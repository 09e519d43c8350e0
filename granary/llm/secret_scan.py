"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model learns random strings, the other ordinary identifiers and words, both from labelled samples: strings made for the
purpose, and the corpus' own tokens, labelled by whether a base pattern marks them.  A stretch of a token is a secret if the evidence
for the first model against the second, added up over its characters, is large enough.  So short strings need to be odder than long
ones, and there is no rule about lengths or kinds of characters beside the models.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
#: Characters of tokens; all others separate them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
#: Bits of evidence for a random string from which on a stretch is a secret.
EVIDENCE = 24.0
#: Code of a character: its place in ALPHABET, or EDGE; also the row of the transition from an edge.
EDGE = len(ALPHABET)
_CODES = np.full(129, EDGE, np.uint8)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(EDGE)


def codes_of(text: str) -> np.ndarray:
    """Codes of the text's characters, with an edge before and after."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(points) + 2, EDGE, np.uint8)
    out[1:-1] = _CODES[np.minimum(points, 128)]
    return out


def transitions(codes: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """How often each character follows each other one or an edge, at the chosen places."""
    to = codes[1:][at].astype(np.int64)
    return np.bincount(codes[:-1][at].astype(np.int64) * (EDGE + 1) + to, minlength=(EDGE + 1) ** 2).reshape(EDGE + 1, EDGE + 1)


class MarkovModel:
    """Character bigrams with add-one smoothing: log2 probabilities of a character after an edge or another one."""

    def __init__(self, counts: np.ndarray):
        counts = counts[:, :EDGE] + 1.0
        self.table = np.log2(counts / counts.sum(axis=1, keepdims=True))


def labelled_samples(seed: int = 11, n: int = 4000) -> list[tuple[str, int]]:
    """A labelled sample of bounded size: random strings (1) and identifiers as people write them (0)."""
    rng = random.Random(seed)
    words = (
        "account active address after align alpha amount answer array async batch before block body buffer build cache call change char check class client close code color column command common "
        "config content context control copy count create current data date default delete delta detail device display document domain element email encode engine entry error event export extra factor false feature "
        "field file filter final first flag font format frame from function get global group handle header height hidden html image import index info init input item join key label last layout left length level line link "
        "list load local lock login main map mask master match max menu merge message method min mode model module month name network next node null number object offset open option order output owner page panel parent parse "
        "path pattern phone pixel plugin point policy pool port post prefix print process product profile property proxy public query queue random range read record remove render report request reset resource response "
        "result return right role root route row sample save schema scope score script search select server service session set shape signal size sort source stack start state status step store stream string style "
        "suffix sum switch system table target task template test text theme thread time title toggle tool total track tree trigger true type unit update upload url user util valid value vector version view visible width window word write year zone"
    ).split()
    out: list[tuple[str, int]] = []
    alphabets = [ALPHABET[:62], ALPHABET[:64], "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef", "0123456789ABCDEF"]
    for _ in range(n):
        out.append(("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64))), 1))
        parts = [rng.choice(words) for _ in range(rng.randint(3, 7))]
        style = rng.randrange(5)
        if style == 0:
            s = "_".join(parts)
        elif style == 1:
            s = "-".join(parts)
        elif style == 2:
            s = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 3:
            s = "/".join(parts)
        else:
            s = "_".join(parts).upper()
        if rng.random() < 0.5:
            s += rng.choice(("_", "-", "/", "")) + str(rng.randrange(10 ** rng.randint(1, 8)))
        out.append((s, 0))
    return out


def train(samples: Sequence[tuple[str, int]], counts: np.ndarray | None = None) -> np.ndarray:
    """Bits of evidence of each transition, from labelled strings and, where given, transitions counted in labelled text (by label)."""
    seen = np.zeros((2, EDGE + 1, EDGE + 1)) if counts is None else counts.astype(float)
    if counts is not None:
        # The corpus weighs as much as the strings made for the purpose, whatever its size.
        made = np.array([sum(len(s) for s, y in samples if y == k) for k in (0, 1)], float)
        seen *= np.minimum(1.0, made / np.maximum(seen[:, :, :EDGE].sum(axis=(1, 2)), 1))[:, None, None]
    for s, y in samples:
        seen[int(y)] += transitions(codes_of(s))
    return MarkovModel(seen[1]).table - MarkovModel(seen[0]).table


def labelled_counts(text: str) -> np.ndarray:
    """Transitions within the text's tokens, those that a base pattern marks as a secret's value apart: (2, from, to)."""
    codes = codes_of(text)
    secret = np.zeros(len(codes) - 1, bool)
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            secret[m.start(2) : m.end(2)] = True
    for start, kind, end in base_spans(text):
        if KINDS[kind] != "assign":
            secret[start:end] = True
    return np.stack([transitions(codes, ~secret), transitions(codes, secret)])


def corpus_counts(docs: DataFrame, id_col: str, text_col: str, rows: int, seed: int) -> np.ndarray:
    """Labelled transitions of at most ``rows`` documents, chosen by a hash of their ids; tables of them, not texts, come to the driver."""
    ids = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("chosen")).distinct()
    chosen = ids.orderBy(F.xxhash64("chosen", F.lit(seed)), "chosen").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("chosen"), F.col(f"`{text_col}`").cast("string").alias("t")).join(F.broadcast(chosen), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, EDGE + 1, EDGE + 1), np.int64)
        for b in batches:
            for t in b.column(0):
                total += labelled_counts(t.as_py() or "")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    # Summed on the cluster: the driver gets one row for each transition, at most 9,800.
    got = texts.select("t").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * (EDGE + 1) ** 2, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(2, EDGE + 1, EDGE + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of the base patterns: matches are leftmost and non-overlapping per kind, then too short ones are dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def stretches(bits: np.ndarray, start: int, least: float) -> list[tuple[int, int]]:
    """Stretches whose bits add up to ``least`` or more, the best one first, then those left and right of it."""
    out, todo = [], [(0, len(bits))]
    while todo:
        u, v = todo.pop()
        sums = np.concatenate([[0.0], np.cumsum(bits[u:v])])
        gain = sums - np.minimum.accumulate(sums)
        end = int(gain.argmax())
        if gain[end] < least:
            continue
        begin = int(sums[: end + 1].argmin())
        out.append((start + u + begin, start + u + end))
        todo += [(u, u + begin), (u + end, v)]
    return out


def model_spans(text: str, evidence: np.ndarray, least: float = EVIDENCE) -> list[tuple[int, int, int]]:
    """Stretches of tokens for which the evidence adds up to ``least`` bits."""
    codes = codes_of(text)
    inside = codes[1:-1] != EDGE
    if not inside.any():
        return []
    bits = np.where(inside, evidence[codes[:-2], np.minimum(codes[1:-1], EDGE - 1)], 0.0)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    # No stretch is worth more than the positive bits of its token, which rules nearly all tokens out at once.
    most = np.add.reduceat(np.maximum(bits, 0.0), np.minimum(edges, len(bits) - 1))[::2]
    out = []
    for u, v in zip(begin[most >= least].tolist(), end[most >= least].tolist()):
        out += [(a, 3, b) for a, b in stretches(bits[u:v], u, least)]
    return sorted(out)


def scan_secrets(docs: DataFrame, samples: Sequence[tuple[str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = EVIDENCE, train_rows: int = 2000, seed: int = 3) -> DataFrame:
    """``doc_id, spans: array<struct<kind, start, end>>`` of every row, by start, then kind as in KINDS.

    The models are fitted on ``samples`` (string, 1 for random; None: made here) and on at most ``train_rows`` documents (the bound of the labelled sample);
    every whole text is scanned.  Spans of the models may overlap those of the base patterns, which all stay.
    Offsets are code points, ends exclusive.  Null texts are empty; null ids stay null; repeated rows are repeated;
    an empty table gives an empty result; extra columns don't matter.
    """
    evidence = train(labelled_samples() if samples is None else samples, corpus_counts(docs, id_col, text_col, train_rows, seed))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = []
                for t in b.column(1).to_pylist():
                    found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base_spans(t or "") + model_spans(t or "", evidence, least))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return two.mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")
