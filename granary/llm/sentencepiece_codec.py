"""SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is parsed here, and its normaliser, metaspace marker, piece scores (unigram) or merges (BPE) and byte
fallback are rebuilt as a tokenizers pipeline.  Where no piece crosses a word boundary, which is checked
when the model is loaded, words are encoded once and remembered; new words are encoded in multithreaded batches.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered

META = "▁"
#: Piece types and model types of the protobuf: fixed values.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words remembered by a worker in each of two generations (of at most so many characters, so some 50 MB in all), words encoded as one
#: text, and characters encoded in one call.
WORDS, WORD_CHARS, LINE_WORDS, BATCH_CHARS = 120_000, 64, 64, 1 << 21


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, struct.unpack("<d" if kind == 1 else "<f", data[at : at + size])[0]
            at += size
        else:
            raise ValueError("not a SentencePiece model")


class SentencePieceModel:
    """What the protobuf holds: pieces, scores, types, and the switches of trainer and normaliser."""

    def __init__(self, proto: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict[int, int | bytes | float] = {}
        norm: dict[int, int | bytes | float] = {}
        for number, value in _fields(proto):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(float(own.get(2, 0.0)))
                self.types.append(int(own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if not self.pieces:
            raise ValueError("the model has no pieces")
        self.kind = int(trainer.get(3, UNIGRAM))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are known")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_space = bool(trainer.get(24, 0))
        self.unk_id = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.charsmap = bytes(norm.get(2, b""))
        self.dummy_prefix = bool(norm.get(3, 1))
        self.trim = bool(norm.get(4, 1))
        self.escape = bool(norm.get(5, 1))
        self.unk_surface = trainer.get(44, " ⁇ ".encode())
        # With one piece across a word boundary, words can't be encoded apart.
        self.by_word = self.escape and not any(t in (NORMAL, USER, UNUSED) and META in p.lstrip(META) for p, t in zip(self.pieces, self.types))


def build_tokenizer(model: SentencePieceModel, whole_text: bool = True):
    """A tokenizers pipeline; ``whole_text=False`` leaves out the steps that apply once per text."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    usable = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t in (NORMAL, USER, UNUSED)}
    if model.kind == UNIGRAM:
        hidden = min(model.scores) - 1e6
        scored = [(p, s if t in (NORMAL, USER, UNKNOWN) else hidden) for p, s, t in zip(model.pieces, model.scores, model.types)]
        tok = Tokenizer(models.Unigram(scored, model.unk_id, byte_fallback=model.byte_fallback))
    else:
        ranked = []
        for piece, i in usable.items():
            if len(piece) < 2 or model.types[i] != NORMAL:
                continue
            blank = not piece.strip(META)
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in usable and b in usable:
                    # Pieces of equal score merge from the left; for runs of the marker that means growing the first one, so long ones go first.
                    ranked.append((-model.scores[i], -len(piece) if blank else 0, usable[piece], usable[a], a, b))
        ranked.sort()
        vocab = {p: i for i, p in enumerate(model.pieces)}
        tok = Tokenizer(models.BPE(vocab, [(r[4], r[5]) for r in ranked], unk_token=model.pieces[model.unk_id], fuse_unk=True, byte_fallback=model.byte_fallback))
    steps = []
    if whole_text:
        if model.charsmap:
            steps.append(normalizers.Precompiled(model.charsmap))
        if model.trim:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(META if model.escape else " "))
        if model.escape:
            steps.append(normalizers.Replace(" ", META))
        if steps:
            tok.normalizer = normalizers.Sequence(steps)
    if model.by_word:
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{META}*[^{META}]+|{META}+"), "isolated")
    return tok


class Codec:
    """Encodes and decodes texts by one model."""

    def __init__(self, proto: bytes, threads: int = 2):
        # Read by the library's thread pool when it starts in this process.
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.model = SentencePieceModel(proto)
        self.by_words = self.model.by_word and not (self.model.charsmap or self.model.trim)
        # These normalisers look across words: then whole texts are left to the library.
        self.whole = None if self.by_words else build_tokenizer(self.model)
        self.inner = build_tokenizer(self.model, whole_text=False)
        self.words = Remembered(WORDS)
        self.opens = np.array([p.startswith(META) for p in self.model.pieces])
        self.find = re.compile(f"{META}*[^{META}]+|{META}+").findall
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else self.model.unk_surface if t == UNKNOWN else p.replace(META, " ").encode() for p, t in zip(self.model.pieces, self.model.types)]

    def _batches(self, tok, texts: Sequence[str]) -> Iterator[tuple[int, ...]]:
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            for e in tok.encode_batch_fast(list(texts[at:end]), add_special_tokens=False):
                yield tuple(e.ids)
            at = end

    def _words(self, words: Sequence[str]) -> list[bytes]:
        """Ids of each word, as bytes of 32-bit integers.

        Words of one marker and more are encoded many at a time, as the text they make: where a piece starts with the marker, so does a word.
        """
        plain = [w for w in words if len(w) > 1 and w[0] == META and w.find(META, 1) < 0]
        found: dict[str, bytes] = {}
        lines = [plain[i : i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        for line, ids in zip(lines, self._batches(self.inner, ["".join(x) for x in lines])):
            ids = np.array(ids, np.int32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(line) and not at[0]:
                raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
                found.update(zip(line, (raw[u:v] for u, v in zip([0, *ends], ends))))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, (np.array(x, np.int32).tobytes() for x in self._batches(self.inner, rest))))
        return [found[w] for w in words]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        m = self.model
        if not self.by_words:
            return [np.array(x, np.int32) for x in self._batches(self.whole, texts)]
        split = [self.find(((META if m.dummy_prefix and t else "") + t).replace(" ", META)) for t in texts]
        known = self.words
        here: dict[str, bytes] = {}
        new = []
        for ws in split:
            for w in ws:
                if w not in here:
                    got = known[w]
                    if got is None:
                        new.append(w)
                        here[w] = b""
                    else:
                        here[w] = got
        for w, got in zip(new, self._words(new)):
            here[w] = got
            if len(w) <= WORD_CHARS:
                known.keep(w, got)
        return [np.frombuffer(b"".join(map(here.__getitem__, ws)), np.int32) for ws in split]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, the marker in front is taken off."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        if self.model.dummy_prefix and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")

    def round_trips(self, text: str, ids: Sequence[int]) -> bool:
        """Whether decoding gives the very text back; a marker in the text comes back as a space, so such a text does not."""
        return self.decode(ids) == text


@lru_cache(maxsize=2)
def _codec(proto: bytes, threads: int) -> Codec:
    return Codec(proto, threads)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, docs_at_once: int = 1024) -> DataFrame:
    """``doc_id, n_tokens, ids: array<int>, round_trip, decoded_sha256`` of every row and its whole text.

    The ids are decoded again; ``decoded_sha256`` is the digest of the text that gives, as lowercase hex.
    ``round_trip`` says whether decoding the ids gives the very text back; it is false where the text holds the marker U+2581, which
    stands for a space in pieces.  The model file is read on the driver and
    sent along, so executors need no copy of it.  A null text counts as empty and has no tokens; null ids stay null;
    repeated rows are repeated; an empty table gives an empty result; extra columns don't matter.
    """
    with open(model_path, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(proto, threads)
        for b in batches:
            # Portions of so many rows, and of so many bytes if more than one.
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            cuts, held = [0], 0
            for i, n in enumerate(size.tolist()):
                if i > cuts[-1] and (held + n > BATCH_CHARS or i - cuts[-1] >= docs_at_once):
                    cuts.append(i)
                    held = 0
                held += n
            for at, end in zip(cuts, [*cuts[1:], b.num_rows]):
                part = b.slice(at, end - at)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = codec.encode(texts)
                decoded = [codec.decode(i.tolist()) for i in ids]
                same = [d == t for d, t in zip(decoded, texts)]
                digests = [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array(same), pa.array(digests)], ["doc_id", "n_tokens", "ids", "round_trip", "decoded_sha256"]
                )

    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return two.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean, decoded_sha256 string")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", threads: int = 2) -> DataFrame:
    """``doc_id, text`` from ids; null ids arrays give null texts."""
    with open(model_path, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(proto, threads)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else codec.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")
