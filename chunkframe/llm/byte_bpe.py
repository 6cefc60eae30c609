"""Byte-level BPE encoding and decoding over Arrow batches.

The merges of a rank file (``base64 rank`` lines) are rebuilt for the
``tokenizers`` library, whose byte-level model works on a printable alphabet:
every byte is mapped to one character.  ``encode`` yields ids and, if asked,
code-point offsets; ``decode`` turns ids into the tokens' characters and these by the
reversed byte table into bytes, so a token that holds only a part of a character gives
exactly its bytes back.  As text, such parts become U+FFFD, are left out, are an error, or
make the row null (``text_errors``).

Defined results: a null text encodes as the empty text (no ids, zero bytes);
null ids decode to zero bytes; empty tables give empty tables; repeated rows
are encoded once per row; all other columns pass through untouched, but an input
column with the name of an output is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import in_parts, without

_SPARK_TYPES = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType(), False),
    "ids_le": T.BinaryType(),
    "offsets_sha256": T.StringType(),
    "starts": T.ArrayType(T.IntegerType(), False),
    "ends": T.ArrayType(T.IntegerType(), False),
}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_alphabet() -> list[str]:
    """Printable Latin-1 bytes stand for themselves, the others for U+0100 onward."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A ``tokenizers`` definition that merges whatever pair the ranks join,
    lowest rank first: every split of a token into two tokens is a merge."""
    chars = byte_alphabet()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for cut in range(1, len(token)):
            a, b = token[:cut], token[cut:]
            if a in ranks and b in ranks:
                merges.append([shown[a], shown[b]])
    split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
             "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
             "vocab": {shown[t]: r for t, r in ranks.items()}, "merges": merges}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [],
                       "normalizer": None, "pre_tokenizer": split, "post_processor": None,
                       "decoder": split, "model": model})


class Encoder:
    """Text to ids by the ``tokenizers`` model: the pattern cuts a text into matches, a
    match's bytes are mapped to characters and merged.  Short matches are remembered, as
    most of a text is made of words met before; the memo is bounded."""

    MEMO, MEMO_CHARS = 100_000, 48

    def __init__(self, definition: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition).model
        self.matches = regex.compile(pattern).findall
        chars = byte_alphabet()
        self.alphabet = dict(enumerate(chars))
        self.known: dict[str, list[int]] = {}
        # bytes of each token: one character of the alphabet stands for each
        vocab = json.loads(definition)["model"]["vocab"]
        self.lengths = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)

    def _tokens(self, match: str):
        return self.model.tokenize(match.encode().decode("latin-1").translate(self.alphabet))

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        get = known.get
        for match in self.matches(text):
            found = get(match)
            if found is None:
                found = [t.id for t in self._tokens(match)]
                if len(match) <= self.MEMO_CHARS:
                    if len(known) >= self.MEMO:
                        known.clear()
                    known[match] = found
            out += found
        return out

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, past the last) of the characters that each token's bytes touch."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if not text.isascii():
            raw = np.frombuffer(text.encode(), np.uint8)
            owner = np.cumsum((raw & 0xC0) != 0x80) - 1
            starts, ends = owner[starts], owner[ends - 1] + 1
        return starts, ends


def _encoder(definition: str, pattern: str) -> Encoder:
    """One encoder per Python worker, kept across its tasks."""
    import sys

    held = sys.__dict__.setdefault("_chunkframe_encoder", {})  # task functions come with globals of their own
    key = hash((definition, pattern))
    if key not in held:
        held.clear()
        held[key] = Encoder(definition, pattern)
    return held[key]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


# Fixed value: the pattern of the vocabulary's training, which cuts a text into matches.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "starts", "ends"), pattern: str = PATTERN) -> DataFrame:
    """Add the columns ``outputs`` to ``df``: ``n_tokens``, ``ids``, ``ids_le`` (the
    ids packed as little-endian unsigned 32-bit integers, the form of token shards),
    ``starts`` and ``ends`` (code points of the text that each token touches) and
    ``offsets_sha256`` (of all starts, then all ends, packed likewise)."""
    df = without(df, *outputs, keep=(text_col,))
    definition = tokenizer_json(read_ranks(ranks_path))
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, _SPARK_TYPES[c]) for c in outputs)])
    with_offsets, with_digests = bool({"starts", "ends"} & set(outputs)), "offsets_sha256" in outputs

    def run(batches):
        encoder = _encoder(definition, pattern)
        for batch in in_parts(batches):
            ids, starts, ends, digests = [], [], [], []
            for text in batch.column(text_col):
                text = text.as_py() or ""
                ids.append(np.array(encoder.ids(text), np.uint32))
                if with_offsets or with_digests:
                    a, b = encoder.offsets(text, ids[-1])
                    if with_offsets:
                        starts.append(a)
                        ends.append(b)
                    if with_digests:
                        digests.append(hashlib.sha256(np.concatenate((a, b)).astype("<u4").tobytes()).hexdigest())
            made = {"n_tokens": lambda: pa.array([len(x) for x in ids], pa.int64()),
                    "ids": lambda: _lists(ids), "starts": lambda: _lists(starts), "ends": lambda: _lists(ends),
                    "ids_le": lambda: pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), "offsets_sha256": lambda: pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(made[c]() for c in outputs)], [*batch.schema.names, *outputs])

    return df.mapInArrow(run, schema)


class Decoder:
    """Ids to bytes: ids to characters of the byte alphabet, and these back to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        chars = byte_alphabet()
        self.tokens: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = "".join(chars[b] for b in token)
        self.byte_of = np.zeros(max(map(ord, chars)) + 1, np.uint8)  # the reversed table
        self.byte_of[[ord(c) for c in chars]] = np.arange(256)

    def bytes(self, ids: list[int]) -> bytes:
        shown = "".join(map(self.tokens.__getitem__, ids))
        return self.byte_of[np.frombuffer(shown.encode("utf-16-le"), "<u2")].tobytes()


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids_le", output: str = "decoded", text_errors: str | None = None) -> DataFrame:
    """Add ``output``: the bytes that the ids (packed, or an array of ints) stand for; with
    ``text_errors`` their text (see ``text_of``).  An id without a token is an error."""
    df = without(df, output, keep=(ids_col,))
    decoder = Decoder(read_ranks(ranks_path))
    packed = isinstance(df.schema[ids_col].dataType, T.BinaryType)

    def run(batches):
        for batch in in_parts(batches):
            out = []
            for row in batch.column(ids_col):
                ids = row.as_py() if row.is_valid else []
                found = decoder.bytes(np.frombuffer(ids, "<u4").tolist() if packed and ids else ids or [])
                out.append(text_of(found, text_errors) if text_errors else found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string() if text_errors else pa.binary())], [*batch.schema.names, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.StringType() if text_errors else T.BinaryType())]))


def text_of(decoded: bytes, errors: str = "replace") -> str | None:
    """Decoded bytes as text.  Parts of characters, where ids are cut inside one: U+FFFD
    (``replace``), left out (``ignore``), an error (``strict``) or no text (``null``)."""
    try:
        return decoded.decode("utf-8", "strict" if errors == "null" else errors)
    except UnicodeDecodeError:
        if errors == "null":
            return None
        raise


def digests(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and keep the digests of both and of the offsets per row."""
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    coded = encode(slim, ranks_path, outputs=("n_tokens", "ids_le", "offsets_sha256")).drop("text")
    return decode(coded, ranks_path).select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "offsets_sha256"
    )
