"""Token counts by compiled finite-state transducers whose chunk maps compose by prefix scan.

Two deterministic transducers are compiled for a byte-level BPE with the usual word pattern.

* The word transducer reads character classes. A transition goes to a state and says whether a word
  starts before this character, before the last one, or not at all. Text is cut into chunks of equal
  length; every chunk becomes a map from entry state to exit state, the maps compose (they are
  associative) in a parallel prefix scan, and with its entry state known each chunk then emits its
  word starts. Documents follow each other in one buffer, with an end class that resets the state, so
  long texts and short ones cost the same per character.
* The piece transducer reads the bytes of a word through an automaton of all tokens. Its state is the
  sequence of last tokens over the prefixes read, a transition adds one token: the last token of a prefix is the longest token that
  ends there and follows the last token before it in canonical BPE order, and the annotation is the
  count of the earlier prefix plus one. Which token may follow which depends only on the pair, and
  is compiled on demand from the merge table.

Whole words become single annotated transitions in a table of bounded size, which changes no
result. Rows never move: there is no shuffle.

Defined results: null texts are empty (0 bytes, 0 tokens); special strings inside texts are handled
as the tokenizer's file says (matched first, one token each). Rows are independent; an empty table
stays empty; other columns are not read.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import whole
from loglattice.llm.tokenizer_files import resolve

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
CHUNK = 256
TABLE_WORDS = 400_000
# Characters handled in one buffer.
BUFFER_CHARS = 1 << 20

# ---- word transducer

# Character classes. APO is the apostrophe; the contraction letters have classes of their own.
END, LETTER, NUMBER, SPACE, WHITE, OTHER, APO, C_S, C_T, C_D, C_M, C_L, C_V, C_E, C_R = range(15)
CLASSES = 15
LETTERS = frozenset((LETTER, C_S, C_T, C_D, C_M, C_L, C_V, C_E, C_R))
# States: what the running word is. S_APO has read an apostrophe that began a word; S_APO_x one more letter of it.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE, S_SPACES, S_WHITES, S_APO, S_APO_L, S_APO_V, S_APO_R, S_DONE = range(13)
STATES = 13
NONE, HERE, BACK, BOTH = range(4)


def word_step(state: int, cls: int) -> tuple[int, int]:
    """Next state and where words start: not at all, before this character, before the last one, or both.

    S_SPACE: a space that begins a run of white space and may begin the next word; S_SPACES: a space
    with white space before it; S_WHITE and S_WHITES: the same for other white space.
    """
    if cls == END:
        return S_START, NONE
    white = cls in (SPACE, WHITE)
    if white:
        after = S_SPACE if cls == SPACE else S_WHITE
        if state in (S_SPACE, S_SPACES, S_WHITE, S_WHITES):
            return (S_SPACES if cls == SPACE else S_WHITES), NONE
        return after, HERE
    kind = S_LETTER if cls in LETTERS else S_NUMBER if cls == NUMBER else S_OTHER
    fresh = S_APO if cls == APO else kind
    if state in (S_SPACE, S_SPACES):
        # One space joins the word; white space before it is a word of its own.
        return kind, (BACK if state == S_SPACES else NONE)
    if state == S_WHITE:
        return fresh, HERE
    if state == S_WHITES:
        # The last white character stands alone, the run before it is a word.
        return fresh, BOTH
    if state == S_LETTER and kind == S_LETTER or state == S_NUMBER and kind == S_NUMBER or state == S_OTHER and kind == S_OTHER:
        return kind, NONE
    if state == S_APO:
        if cls in (C_S, C_T, C_D, C_M):
            return S_DONE, NONE
        if cls == C_L:
            return S_APO_L, NONE
        if cls == C_V:
            return S_APO_V, NONE
        if cls == C_R:
            return S_APO_R, NONE
        return (S_OTHER, NONE) if kind == S_OTHER else (kind, HERE)
    if state == S_APO_L and cls == C_L or state in (S_APO_V, S_APO_R) and cls == C_E:
        return S_DONE, NONE
    if state in (S_APO_L, S_APO_V, S_APO_R):
        # No contraction: the apostrophe is a word, the letter after it begins another.
        return (kind, BACK) if kind == S_LETTER else (fresh, BOTH)
    return fresh, HERE


def word_tables() -> tuple[np.ndarray, np.ndarray]:
    steps = [[word_step(s, c) for c in range(CLASSES)] for s in range(STATES)]
    return np.array([[t for t, _ in row] for row in steps], np.uint8), np.array([[o for _, o in row] for row in steps], np.uint8)


def class_table() -> np.ndarray:
    """The class of every code point, from Unicode categories; white space as the pattern's \\s."""
    import regex

    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        group = unicodedata.category(chr(code))[0]
        if group in "LN":
            table[code] = LETTER if group == "L" else NUMBER
    for code in range(0x3001):
        if regex.match(r"\s", chr(code)) and not 0x1C <= code <= 0x1F:
            table[code] = WHITE
    table[ord(" ")] = SPACE
    table[ord("'")] = APO
    for char, cls in zip("stdmlver", (C_S, C_T, C_D, C_M, C_L, C_V, C_E, C_R), strict=True):
        table[ord(char)] = cls
    return table


def entry_states(classes: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Entry state of each row of ``classes`` (chunks of one buffer): maps of all chunks, composed by prefix scan."""
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (len(classes), STATES)).copy()
    for column in range(classes.shape[1]):
        maps = follow[maps, classes[:, column, None]]
    # Inclusive scan: after step d each map stands for up to 2d chunks that end with its own.
    step = 1
    while step < len(maps):
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    return np.concatenate([[S_START], maps[:-1, S_START]]).astype(np.uint8)


def word_starts(classes: np.ndarray, follow: np.ndarray, emit: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which words start in a buffer of classes."""
    rows = -(-len(classes) // chunk)
    grid = np.full(rows * chunk, END, np.uint8)
    grid[: len(classes)] = classes
    grid = grid.reshape(rows, chunk)
    state = entry_states(grid, follow)
    said = np.empty(grid.shape, np.uint8)
    for column in range(chunk):
        said[:, column] = emit[state, grid[:, column]]
        state = follow[state, grid[:, column]]
    said = said.reshape(-1)[: len(classes)]
    starts = np.zeros(len(classes), bool)
    starts[(said == HERE) | (said == BOTH)] = True
    starts[np.flatnonzero((said == BACK) | (said == BOTH)) - 1] = True
    return np.flatnonzero(starts)


# ---- piece transducer

# Between words in one run; no byte is written so.
BREAK = "\u0100"

class PieceTransducer:
    """Counts tokens of words, given the merges of a byte-level BPE in order of rank."""

    def __init__(self, vocabulary: list[bytes], merges: list[tuple[int, int, int]]) -> None:
        self.ids = {token: i for i, token in enumerate(vocabulary)}
        self.merged = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
        # A token's rank is that of the merge that makes it; single bytes have none.
        self.made = {c: (rank, a, b) for rank, (a, b, c) in enumerate(merges)}
        # All tokens that end at a position, longest first.
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.follows: dict[tuple[int, int], bool] = {}
        self.words: dict[str, int] = {}

    def may_follow(self, first: int, second: int) -> bool:
        """True if canonical BPE leaves the two tokens apart when it meets them side by side."""
        known = self.follows.get((first, second))
        if known is None:
            known = self.follows[first, second] = self._apart(first, second)
        return known

    def _apart(self, first: int, second: int) -> bool:
        """Undo the merges of both tokens from the latest on, watching the two pieces that face each other.

        If they have a merge of their own with a rank before the merge just undone, it would have come first.
        """
        left, right = first, second
        limit = float("inf")
        while True:
            across = self.merged.get((left, right))
            if across is not None and across[0] < limit:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            # The later merge is undone first. Equal ranks run from left to right, so the right one is later.
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                # A merge inside the right token comes after one across the border of the same rank.
                limit, right = b[0] + 0.5, b[1]

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each word, in one run of the compiled automaton over all of them."""
        raw = [w.encode().decode("latin-1") for w in words]
        text = BREAK.join(raw) + BREAK
        # Per position: the last token of the prefix that ends there (-1: none), and its number of tokens.
        last, number = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        follows, begun = self.follows, 0
        ends = iter(accumulate(len(r) + 1 for r in raw))
        until, done = next(ends, 0), -1
        for end, (length, token) in self.automaton.iter(text):
            if end == done:
                continue
            while end >= until:
                begun, until = until, next(ends)
            start = end + 1 - length
            if start == begun:
                key = (token, -1)
                good = follows.get(key)
                if good is None:
                    good = self.canonical(token)
                if good:
                    last[end + 1], number[end + 1], done = token, 1, end
            elif (before := last[start]) >= 0:
                key = (before, token)
                good = follows.get(key)
                if good is None:
                    good = self.may_follow(before, token)
                if good:
                    last[end + 1], number[end + 1], done = token, number[start] + 1, end
        return [number[at - 1] for at in accumulate(len(r) + 1 for r in raw)]

    def canonical(self, token: int) -> bool:
        """True if the token's own text is encoded as this token (its two halves meet and merge)."""
        known = self.follows.get((token, -1))
        if known is None:
            rank_a_b = self.made.get(token)
            known = rank_a_b is None or self._meets(token)
            self.follows[token, -1] = known
        return known

    def _meets(self, token: int) -> bool:
        rank, a, b = self.made[token]
        return self.canonical(a) and self.canonical(b) and self._apart_until(a, b, rank)

    def _apart_until(self, first: int, second: int, rank: int) -> bool:
        """No merge across the border earlier than ``rank``, which is the one of the whole."""
        saved = self.merged.pop((first, second))
        try:
            return self._apart(first, second)
        finally:
            self.merged[first, second] = saved


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes bytes as printable characters: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Counter:
    """Both transducers of one tokenizer file."""

    def __init__(self, name: str) -> None:
        with open(resolve(name), encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{name}: only plain byte-level BPE can be compiled")
        alphabet = byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        entries = [t for t in model["vocab"] if t not in special]
        raw = {t: bytes(alphabet[c] for c in t) for t in entries}
        order = {t: i for i, t in enumerate(entries)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pieces = PieceTransducer([raw[t] for t in entries], [(order[a], order[b], order[a + b]) for a, b in pairs])
        self.special = sorted(special, key=len, reverse=True)
        self.classes = class_table()
        self.follow, self.emit = word_tables()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        totals = [0] * len(texts)
        plain, owner = [], []
        for k, text in enumerate(texts):
            parts = [text]
            for mark in self.special:
                if mark in text:
                    split = [p.split(mark) for p in parts]
                    totals[k] += sum(len(p) - 1 for p in split)
                    parts = [x for p in split for x in p]
            plain += parts
            owner += [k] * len(parts)
        at = 0
        while at < len(plain):
            size, stop = 0, at
            while stop < len(plain) and (stop == at or size + len(plain[stop]) < BUFFER_CHARS):
                size += len(plain[stop]) + 1
                stop += 1
            for k, n in zip(owner[at:stop], self._buffer(plain[at:stop]), strict=True):
                totals[k] += n
            at = stop
        return totals

    def _buffer(self, texts: list[str]) -> list[int]:
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes[codes]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes[ends] = END
        starts = word_starts(classes, self.follow, self.emit)
        # A document's last word ends at its end mark.
        cuts = np.unique(np.concatenate([starts, ends]))
        words = self.pieces.words
        if len(words) > TABLE_WORDS:
            words.clear()
        is_end = np.zeros(len(classes), bool)
        is_end[ends] = True
        bounds = cuts.tolist()
        pieces = [joined[start:end] for start, end in zip(bounds, [*bounds[1:], len(joined)], strict=True)]
        new = list(set(pieces) - words.keys())
        words.update(zip(new, self.pieces.counts(new), strict=True))
        each = np.fromiter(map(words.__getitem__, pieces), np.int64, len(pieces))
        each[is_end[cuts]] = 0  # an end mark and the nothing after it
        running = np.cumsum(each)
        return np.diff(running[np.searchsorted(cuts, ends)], prepend=0).tolist()


_COUNTERS: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    if name not in _COUNTERS:  # compiled once per Python worker
        _COUNTERS[name] = Counter(name)
    return _COUNTERS[name]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = counter(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                yield pd.DataFrame({"id": part["id"], "n_bytes": part["n_bytes"], "n_tokens": machine.counts(part["text"].tolist())})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), whole(F.col(text_col)).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    done = rows.mapInPandas(count, "id string, n_bytes long, n_tokens long")
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
