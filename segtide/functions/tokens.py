"""Native tokenisers inside the JVM, and the bytes that tokens take.

Nulls give null, empty texts no tokens. Texts are split where tokens part, as tasks of one JVM that run ``regexp_extract_all``
hinder each other: six took 12.5 task seconds for what six that split took 1.8.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, as a class for Java's regular expressions.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: What Python's str.split() parts at: the same and four separators.
PYTHON_SPACE = SPACE + r"\x{1C}-\x{1F}"


def characters(text: Column) -> Column:
    """One token a code point."""
    return F.array_remove(F.split(text, ""), "")


def _between(text: Column, space: str) -> Column:
    """Runs between characters of a class; a run of them at either end leaves an empty text there."""
    return F.array_remove(F.split(text, f"[{space}]+"), "")


def whitespace(text: Column) -> Column:
    """Runs between white space."""
    return _between(text, SPACE)


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"character": characters, "whitespace": whitespace}


def _space_bytes(b: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    space = ((b >= 9) & (b <= 13)) | (b == 32)
    after = lambda n: np.concatenate((b[n:], np.zeros(min(n, len(b)), np.uint8)))
    one, two = after(1), after(2)
    pair = (b == 0xC2) & ((one == 0x85) | (one == 0xA0))
    general = (b == 0xE2) & (one == 0x80) & ((two >= 0x80) & (two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
    triple = general | (b == 0xE2) & (one == 0x81) & (two == 0x9F) | (b == 0xE1) & (one == 0x9A) & (two == 0x80) | (b == 0xE3) & (one == 0x80) & (two == 0x80)
    for lead, size in ((pair, 2), (triple, 3)):
        for n in range(size):
            space[np.flatnonzero(lead) + n] = True
    return space


def token_ranges(texts: pa.Array, tokenizer: str) -> pa.Array:
    """Lists of (value, byte_start, byte_end) of an array of texts, in passes over their bytes."""
    null = texts.is_null().to_numpy(zero_copy_only=False)
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    border = np.zeros(len(b) + 1, bool)
    border[bounds] = True
    if tokenizer == "character":
        starts = np.flatnonzero((b & 0xC0) != 0x80)
        ends, kept = np.append(starts[1:], len(b)), b
    else:
        solid = ~_space_bytes(b)
        starts = np.flatnonzero(solid & (border[:-1] | ~np.concatenate(([False], solid[:-1]))))
        ends = np.flatnonzero(solid & (border[1:] | ~np.concatenate((solid[1:], [False])))) + 1
        kept = b[solid]
    size = ends - starts
    who = np.searchsorted(bounds, starts, side="right") - 1
    places = pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
    value = pa.StringArray.from_buffers(len(size), places, pa.py_buffer(np.ascontiguousarray(kept)))
    rows = pa.StructArray.from_arrays([value, pa.array((starts - bounds[who]).astype(np.int32)), pa.array((ends - bounds[who]).astype(np.int32))], names=["value", "byte_start", "byte_end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(len(texts) + 1)).astype(np.int32)), rows, mask=pa.array(null))


def with_ranges(text: Column, tokenizer: str) -> Column:
    """Tokens with the UTF-8 bytes they take, ends exclusive. An Arrow function: a running sum inside an expression would copy the array at every token."""

    @F.arrow_udf("array<struct<value:string,byte_start:int,byte_end:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return token_ranges(texts, tokenizer)

    return run(text)


def byte_range(text: Column, tokenizer: str, start: Column, end: Column) -> tuple[Column, Column]:
    """The first byte and the last byte + 1 of tokens start..end of a text, without building all tokens' ranges."""
    if tokenizer == "character":
        return F.octet_length(F.substring(text, F.lit(1), start)), F.octet_length(F.substring(text, F.lit(1), end))
    parts = F.split(text, f"(?<=[{SPACE}])(?=[^{SPACE}])|(?<=[^{SPACE}])(?=[{SPACE}])")
    lead = F.when(text.rlike(f"^[{SPACE}]"), 1).otherwise(0)
    size = lambda n: F.octet_length(F.array_join(F.slice(parts, F.lit(1), n), ""))
    return size(2 * start + lead), size(2 * end - 1 + lead)


def is_single_token(text: Column, tokenizer: str) -> Column:
    """Whether the whole text is one token."""
    tokens = TOKENIZERS[tokenizer](text)
    return (F.size(tokens) == 1) & (F.get(tokens, F.lit(0)) == text)


def flatten(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.array_join(_between(text, PYTHON_SPACE), " ")
