"""SentencePiece models on the tokenizers library.

The model's protobuf is read field by field, and normaliser, metaspace marker, scores and byte
fallback are rebuilt as a tokenizers pipeline: a unigram model takes the scores as they are, a
BPE model turns them into ranked merges and takes a text as a whole.

Every batch is also encoded by the sentencepiece library. The ids are those of the rebuilt
pipeline; where the library gives others, the row says so.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.registry import documents, query, release

MODEL = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"
MARK = "▁"
#: Characters handled at a time, a longer text alone.
CHARS = 1 << 18
#: Threads that encode for one task: it has one core.
THREADS = 1
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


# ---------------------------------------------------------------- the model file


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    mark_after: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: varints as int, the rest as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = varint(at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def parse(raw: bytes) -> Model:
    """A model from the bytes of its file. Fields that do not bear on encoding are skipped."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.mark_after = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unknown = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.squeeze = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Ranked merges of a BPE model: every split of a piece into two pieces, best score first."""
    plain = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    ranked = [
        (-score, at, piece[:cut], piece[cut:])
        for at, (piece, score, kind) in enumerate(model.pieces)
        if kind in (NORMAL, USER)
        for cut in range(1, len(piece))
        if piece[:cut] in plain and piece[cut:] in plain
    ]
    return [(left, right) for _, _, left, right in sorted(ranked)]


def build(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == BPE:
        core = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(model.pieces)},
            merges=merges(model),
            unk_token=model.pieces[model.unknown][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    space = MARK if model.escape else " "
    if model.dummy_prefix and not model.mark_after:
        steps.append(normalizers.Prepend(space))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.kind != BPE and not model.mark_after and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER)):
        # No piece runs across the start of a word, so words can be encoded, and cached, alone. Merges
        # take a whole text in less time than cutting it into words and looking those up.
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *strip])
    return tokenizer


@functools.lru_cache(maxsize=2)
def loaded(raw: bytes, threads: int = THREADS):
    """(tokenizer, sentencepiece processor) of a model, once per Python worker. The thread pool
    is sized before its first use: idle threads of a larger one cost more than they bring."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    import sentencepiece

    return build(parse(raw)), sentencepiece.SentencePieceProcessor(model_proto=raw)


@functools.lru_cache(maxsize=2)
def bare(raw: bytes, threads: int = THREADS):
    """The model's tokenizer without its steps between spaces and marks, or None where others stand
    beside them. Replacing in strings takes less time than in texts that keep track of offsets."""
    from tokenizers import Tokenizer, decoders

    model, whole = parse(raw), loaded(raw, threads)[0]
    if model.charsmap or model.squeeze or model.mark_after or not model.dummy_prefix or not model.escape:
        return None
    tokenizer = Tokenizer(whole.model)
    if whole.pre_tokenizer is not None:
        tokenizer.pre_tokenizer = whole.pre_tokenizer
    tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


# ---------------------------------------------------------------- batches


def decode_batch(raw: bytes, ids: list[list[int]], threads: int = THREADS) -> list[str]:
    """The texts that ids stand for."""
    tokenizer = bare(raw, threads)
    if tokenizer is None:
        return loaded(raw, threads)[0].decode_batch(ids, skip_special_tokens=False)
    return [t.replace(MARK, " ").removeprefix(" ") for t in tokenizer.decode_batch(ids, skip_special_tokens=False)]


def encode_batch(raw: bytes, texts: list[str], threads: int) -> tuple[list[list[int]], list[bool]]:
    """(ids, whether the sentencepiece library gives the same ones) of each text."""
    (tokenizer, processor), plain = loaded(raw, threads), bare(raw, threads)
    marked = texts if plain is None else [f"{MARK}{t}".replace(" ", MARK) if t else t for t in texts]
    ids = [e.ids for e in (plain or tokenizer).encode_batch_fast(marked, add_special_tokens=False)]
    return ids, [a == b for a, b in zip(ids, processor.encode(texts, num_threads=threads))]


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about ``CHARS`` characters. A null text is empty."""
    first, texts, size = 0, [], 0
    for at in range(len(column)):
        text = column[at].as_py() or ""
        if texts and size + len(text) > CHARS:
            yield first, texts
            first, texts, size = at, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(
    docs: DataFrame, text_col: str = "text", *, model: str = MODEL, carry: list[str] | None = None, threads: int = THREADS, digest: bool = False
) -> DataFrame:
    """The ``carry`` columns (all by default) with ``n_tokens``, ``ids`` and ``parity`` (the
    sentencepiece library gives the same ids); with ``digest`` the SHA-256 of the ids as 32-bit little-endian numbers and
    ``round_trip`` (the decoded ids are the text) instead of the ids.

    The model file is read on the driver and travels with the tasks. A null text is encoded as
    the empty text, which has no ids. Columns named like the added ones are replaced.
    """
    raw = _model_bytes(model)
    added = ["n_tokens", "parity", "ids_sha256", "round_trip"] if digest else ["n_tokens", "parity", "ids"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    types = dict(docs.dtypes)
    kinds = ["long", "boolean", *(["string", "boolean"] if digest else ["array<int>"])]
    source = docs.select(*dict.fromkeys([*carry, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch.column(text_col)):
                ids, parity = encode_batch(raw, texts, threads)
                out = [batch.column(c).slice(first, len(texts)) for c in carry]
                out += [pa.array([len(i) for i in ids], pa.int64()), pa.array(parity)]
                if digest:
                    decoded = decode_batch(raw, ids, threads)
                    out.append(pa.array([hashlib.sha256(np.array(i, "<i4").tobytes()).hexdigest() for i in ids]))
                    out.append(pa.array([a == b for a, b in zip(decoded, texts)]))
                else:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, [*carry, *added])
            release()

    return source.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip([*carry, *added], [*(types[c] for c in carry), *kinds])))


def decode(tokens: DataFrame, ids_col: str = "ids", text_col: str = "text", *, model: str = MODEL) -> DataFrame:
    """``tokens`` with the text its ids stand for; null ids give the empty text. A column of that name is replaced."""
    raw = _model_bytes(model)
    keep = [c for c in tokens.columns if c != text_col]
    types = dict(tokens.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = decode_batch(raw, [i.as_py() or [] for i in part.column(ids_col)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, text_col])

    return tokens.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{text_col}` string"]))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    return encode(documents(spark, sf_dir), carry=["doc_id"], digest=True)
