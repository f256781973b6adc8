"""Identifiers of the lines of texts, for whole Arrow batches at a time.

A line's identifier is a hash of its letters alone, in lower case.  Lines without letters, lines whose first
non-blank character is ``#`` and fenced code have none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def split_lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of lines of each text, all lines one after the other); a null text has none."""
    lists = pc.split_pattern(texts, "\n")
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def fence_states(size: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether each line is fenced code: from a line that starts with three backticks to the next one, both included."""
    if not marks.any():
        return np.zeros(len(marks), dtype=bool)
    seen = np.cumsum(marks)
    first = np.cumsum(size) - size
    before = np.repeat(np.where(size > 0, seen[np.minimum(first, len(seen) - 1)] - marks[np.minimum(first, len(marks) - 1)], 0), size)
    return marks | ((seen - before) % 2 == 1)


def mapped(keep: bytes) -> bytes:
    """A table of bytes: letters in lower case, 0 for digits, the bytes to ``keep``, and spaces for all else."""
    return bytes(c if chr(c).islower() else c + 32 if chr(c).isupper() else 48 if 48 <= c <= 57 else c if c in keep else 32 for c in range(128)) + b" " * 128


#: For ``plain``.
WORDS = mapped(b"")
#: A character beyond ASCII that is neither a letter nor a number; two letters are known to Arrow only, which lowers them.
SIGN = r"[^\x00-\x7f\p{L}\p{N}\x{A7CB}\x{A7DC}]"


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """(offsets, bytes) of strings without nulls."""
    texts = texts.cast(pa.string())
    off = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    return off - off[0], data[int(off[0]) : int(off[-1])].to_pybytes() if data is not None else b""


def strings(off: np.ndarray, data: bytes) -> pa.Array:
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data))


def without(off: np.ndarray, data: bytes, drop: bytes) -> tuple[np.ndarray, bytes]:
    """(offsets, bytes) of strings without the bytes to ``drop``."""
    x = np.frombuffer(data, np.uint8)
    gone = np.zeros(len(x), bool)
    for c in drop:
        gone |= x == c
    return off - np.searchsorted(np.flatnonzero(gone), off), data.translate(None, drop)


def squeezed(off: np.ndarray, x: np.ndarray) -> pa.Array:
    """Strings of ASCII with one space, one 0 and one byte 1 for each run of these and no space at either end; no byte is 0."""
    gone = np.zeros(len(x), bool)
    gone[1:] = (x[1:] == x[:-1]) & ((x[1:] == 32) | (x[1:] == 48) | (x[1:] == 1))
    first = off[:-1][off[1:] > off[:-1]]
    gone[first] = x[first] == 32
    off, data = without(off, (x * ~gone).tobytes(), b"\0")
    x = np.frombuffer(bytearray(data), np.uint8)
    last = off[1:][off[1:] > off[:-1]] - 1
    x[last[x[last] == 32]] = 0
    return strings(*without(off, x.tobytes(), b"\0"))


def by_kind(texts: pa.Array, ascii_only: Callable[[pa.Array], pa.Array], other: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The results of one function for the strings whose letters and numbers are ASCII and of another for the rest, in the order of the strings.

    Both see a semicolon for any other character that is neither.
    """
    if texts.type != pa.string() or texts.null_count:
        return other(texts)
    kind = pc.string_is_ascii(texts)
    if not pc.all(kind).as_py():
        texts = pc.replace_with_mask(texts, pc.invert(kind), pc.replace_substring_regex(texts.filter(pc.invert(kind)), SIGN, ";"))
        kind = pc.string_is_ascii(texts)
    mine = kind.to_numpy(zero_copy_only=False)
    if mine.all():
        return ascii_only(texts)
    order = np.argsort(np.r_[np.flatnonzero(mine), np.flatnonzero(~mine)])
    return pa.concat_arrays([ascii_only(texts.filter(kind)), other(texts.filter(pc.invert(kind)))]).take(pa.array(order))


def plain(lines: pa.Array) -> pa.Array:
    """The words of lines in lower case, with one space between them and 0 for each run of digits."""
    return by_kind(lines, plain_of_ascii, plain_of_any)


def plain_of_ascii(lines: pa.Array) -> pa.Array:
    off, data = bytes_of(lines)
    return squeezed(off, np.frombuffer(data.translate(WORDS), np.uint8))


def plain_of_any(lines: pa.Array) -> pa.Array:
    """``plain`` by regular expressions, for all letters."""
    a = pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(lines), r"\d+", "0"), r"[^\p{L}0 ]+", " ")
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(a, " {2,}", " "))


@dataclass
class Lines:
    size: np.ndarray  # number of lines of each text
    key: np.ndarray  # identifier of each line
    counts: np.ndarray  # whether the line has one
    fenced: np.ndarray  # whether it is fenced code
    lines: pa.Array  # the distinct lines
    words: pa.Array  # ``plain`` of these
    at: np.ndarray  # place of each line among them


def line_keys(texts: pa.Array) -> Lines:
    """The lines of texts; equal lines of a batch are looked at once."""
    size, flat = split_lines(texts)
    enc = pc.dictionary_encode(flat)
    lines, at = enc.dictionary, enc.indices.to_numpy()
    start = pc.utf8_ltrim_whitespace(lines)
    words = plain(lines)
    off, data = bytes_of(words)
    left, data = without(off, data, b" 0")
    letters = pc.dictionary_encode(strings(left, data))
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in letters.dictionary.to_pylist()], dtype=np.uint64).view(np.int64)
    own = letters.indices.to_numpy()
    empty = pc.equal(letters.dictionary, "").to_numpy(zero_copy_only=False)[own]
    counts = ~(empty | pc.starts_with(start, "#").to_numpy(zero_copy_only=False))
    fenced = fence_states(size, pc.starts_with(start, "```").to_numpy(zero_copy_only=False)[at])
    return Lines(size, hashes[own][at], counts[at] & ~fenced, fenced, lines, words, at)


def lists_of(size: np.ndarray, values: np.ndarray, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.ListArray:
    """An array of lists of the given sizes; values under ``mask`` are null."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values, kind, mask=mask))
