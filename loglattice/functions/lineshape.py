"""Structures of whole lines, a batch at a time, on Arrow's automaton-based matcher (linear in the line)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions.jsonshape import INVALID_JSON, shape_of, string_tags

# Every digit as 1: the masks treat digits alike, but for the 0 of 0x.
_DIGITS = bytes(ord("1") if chr(b).isdigit() and b < 128 else b for b in range(256))
# Words that begin with a digit may stay as they are, so their digits count.
_DIGIT_WORD = r"\b[0-9]+[A-Za-z_]"
# 1 for digits, 2 for other characters of words, else 0.
_CLASS = bytes(1 if b in b"0123456789" else 2 if b < 128 and (chr(b).isalpha() or b == ord("_")) else 0 for b in range(256))
# Shapes that a task remembers; beyond that it starts afresh.
KNOWN_BYTES = 4 << 20


def _with_data(texts: pa.Array, data: bytes | bytearray) -> pa.Array:
    valid, offsets, _ = texts.buffers()
    return pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, pa.py_buffer(data)], offset=texts.offset)


def _digits_alike(texts: pa.Array) -> pa.Array:
    """The texts with every digit as 1, except a 0 before an x."""
    data = texts.buffers()[2]
    if data is None:
        return texts
    raw = data.to_pybytes()
    alike = raw.translate(_DIGITS)
    if b"0x" in raw:
        alike, was = bytearray(alike), np.frombuffer(raw, np.uint8)
        before = np.flatnonzero(was[1:] == ord("x"))
        np.frombuffer(alike, np.uint8)[before[was[before] == ord("0")]] = ord("0")
    return _with_data(texts, alike)


def _digits_of_words(texts: pa.Array) -> pa.Array:
    """The texts with every digit as 1, except in words of digits and other characters that begin with a digit."""
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    raw = data.to_pybytes()
    classes, alike = np.frombuffer(raw.translate(_CLASS), np.uint8), bytearray(raw.translate(_DIGITS))
    first = classes > 0
    first[1:] &= classes[:-1] == 0
    # A word ends where its text ends.
    begins = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts)]
    begins = begins[begins < len(raw)]
    first[begins] = classes[begins] > 0
    words = np.flatnonzero(first)
    # Such a word holds a digit before another character; what follows up to the next word has no digits.
    mixed = np.searchsorted(words, np.flatnonzero((classes[:-1] == 1) & (classes[1:] == 2)), "right") - 1
    mixed = mixed[(classes[words[mixed]] == 1) & (np.diff(mixed, prepend=-1) > 0)]
    edges = np.zeros(len(raw) + 1, np.int8)
    edges[words[mixed]] += 1
    edges[np.append(words, len(raw))[mixed + 1]] -= 1
    stay = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    np.copyto(np.frombuffer(alike, np.uint8), np.frombuffer(raw, np.uint8), where=stay)
    return _with_data(texts, alike)


def _masked(texts: pa.Array, masks: list[tuple[str, str]]) -> pa.Array:
    for pattern, tag in masks:
        texts = pc.replace_substring_regex(texts, pattern, tag)
    return pc.ascii_trim(texts, " ")


class Structures:
    """All masks over ASCII texts; what is masked once is remembered for the batches that follow.

    Texts that differ in digits only have one structure, but for the digits of words that begin with
    a digit and hold other characters as well.
    """

    def __init__(self, masks: list[tuple[str, str]], finish: Callable[[pa.Array], pa.Array] | None = None):
        self.masks, self.finish, self.known = masks, finish, None

    def _of_shapes(self, shapes: pa.Array) -> pa.Array:
        if self.known is None:
            self.known = shapes.slice(0, 0), shapes.slice(0, 0)
        at = pc.index_in(shapes, value_set=self.known[0])
        new = pc.is_null(at)
        if not pc.any(new).as_py():
            return self.known[1].take(at)
        fresh = shapes.filter(new)
        made = _masked(fresh, self.masks)
        made = self.finish(made) if self.finish else made
        out = pc.replace_with_mask(self.known[1].take(at), new, made)
        kept = [part for part in self.known if part.nbytes <= KNOWN_BYTES]
        self.known = tuple(map(pa.concat_arrays, zip(self.known, (fresh, made), strict=True))) if len(kept) == 2 else (fresh, made)
        return out

    def __call__(self, texts: pa.Array) -> pa.Array:
        alike = _digits_alike(texts)
        shapes = alike.dictionary_encode()
        own = pc.match_substring_regex(shapes.dictionary, _DIGIT_WORD)
        if not pc.any(own).as_py():
            return self._of_shapes(shapes.dictionary).take(shapes.indices)
        # Where the digits of words count, they are part of the shape.
        own = pc.fill_null(own.take(shapes.indices), False)
        shapes = pc.replace_with_mask(alike, own, _digits_of_words(texts.filter(own))).dictionary_encode()
        return self._of_shapes(shapes.dictionary).take(shapes.indices)


def text_structures(texts: pa.Array, masks: list[tuple[str, str]]) -> pa.Array:
    """All masks over one batch of ASCII texts."""
    return Structures(masks)(texts)


def _json_shapes(texts: pa.Array) -> pa.Array:
    tag_of = string_tags()

    def one(document):
        try:
            return shape_of(json.loads(document), tag_of)
        except (ValueError, RecursionError):
            return INVALID_JSON

    return pa.array([one(document) for document in texts.to_pylist()], texts.type)


def _digests(texts: pa.Array) -> pa.Array:
    distinct = texts.dictionary_encode()
    digests = [hashlib.sha256(text.encode()).hexdigest() for text in distinct.dictionary.to_pylist()]
    return pa.array(digests, texts.type).take(distinct.indices)


def line_structures(lines: Column, masks: list[tuple[str, str]], with_json: bool, hashed: bool = False) -> Column:
    """Structures of ASCII texts and, ``with_json``, of texts in braces by their JSON shape; null stays null.

    ``hashed`` gives their SHA-256 in hex, worked out once for equal structures.
    """

    def structures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        text_structures = Structures(masks, _digests if hashed else None)
        for texts in batches:
            braced = pc.fill_null(pc.and_(pc.starts_with(texts, "{"), pc.ends_with(texts, "}")), False)
            if not with_json or not pc.any(braced).as_py():
                yield text_structures(texts)
                continue
            out = text_structures(pc.if_else(braced, pa.scalar(None, texts.type), texts))
            shapes = _json_shapes(texts.filter(braced))
            yield pc.replace_with_mask(out, braced, _digests(shapes) if hashed else shapes)

    return F.arrow_udf(structures, "string")(lines)
