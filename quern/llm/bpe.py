"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries first, so that no call handles more than about ``PIECE`` characters:
a single space between two characters that are no white space always begins a match of the pattern, hence
no match reaches across it and pieces encode as the whole text would.

The library's matcher keeps a place for each character of a run of white space and ends with an error on very long runs.
What the pattern makes of such a run is known: all of it at the end of the text, else all but its last character, is one
match. So runs of ``RUN`` characters or more go to the merges by themselves, as that one match, without the matcher.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm import arrows

PIECE = 50_000
RUN = 1_000
ADDED = ("n_tokens", "ids_le", "decoded", "same")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LONG = regex.compile(r"\s{%d,}+" % RUN)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tokenizer of a rank file; one for each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """`text` cut at the first safe boundary after each `most` characters; without one it stays whole."""
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def blanks(text: str) -> Iterator[tuple[str, bool]]:
    """`text` in parts, with whether a part is the one match that the pattern makes of a long run of white space."""
    at = 0
    for run in _LONG.finditer(text) if len(text) >= RUN else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    if at < len(text) or not text:
        yield text[at:], False


def encode(text: str, tokenizer, whole: Callable) -> np.ndarray:
    """The ids of a text as little-endian unsigned 32-bit integers; `whole` gives a tokenizer that takes any run of
    white space as one match."""
    parts = []
    for part, blank in blanks(text):
        if blank:
            parts.append(whole().encode_to_numpy(part, disallowed_special=()))
        else:
            parts += [tokenizer.encode_to_numpy(x, disallowed_special=()) for x in pieces(part)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens (long), ids_le (binary: the ids as little-endian unsigned 32-bit integers), decoded (binary: the
    bytes that the ids stand for) and same (boolean: whether these are the text's) to each row.

    Encodes without special tokens: their strings are ordinary text. A null text counts as empty and gives no
    ids; very long texts go piece by piece; repeated rows each get their own result; an empty table gives an
    empty one. Bytes that are no UTF-8 are encoded as U+FFFD, so such a row isn't the same. Columns of those names in
    the input are replaced, other columns pass through as they are.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    source = docs.select(*[docs[c] for c in kept])
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.BinaryType()), T.StructField("same", T.BooleanType())]
    schema = T.StructType([*source.schema.fields, *added])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, whole = encoding(rank_file, pattern), lambda: encoding(rank_file, r"\s+")
        for batch in arrows.slices(batches, text):
            sizes, ids, decoded, same = [], [], [], []
            for value, raw in zip(arrows.texts(batch.column(text)), batch.column(text).cast(pa.large_binary()), strict=True):
                found = encode(value, tokenizer, whole)
                back = tokenizer.decode_bytes(found.tolist())
                same.append(back == (raw.as_py() or b""))
                sizes.append(len(found))
                ids.append(found.tobytes())
                decoded.append(back)
            new = [pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return arrows.modest(source).mapInArrow(work, schema)


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids_le", out: str = "decoded") -> DataFrame:
    """Adds `out` (binary): the bytes of the packed ids in column `ids`; null ids count as none."""
    kept = [c for c in encoded.columns if c != out]
    source = encoded.select(*[encoded[c] for c in kept])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(rank_file, pattern)
        for batch in arrows.slices(batches, ids):
            back = [tokenizer.decode_bytes(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=[*kept, out])

    return arrows.modest(source).mapInArrow(work, T.StructType([*source.schema.fields, T.StructField(out, T.BinaryType())]))
