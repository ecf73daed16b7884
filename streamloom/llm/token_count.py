"""Token counts by finite-state tokenizer compilation.

Two deterministic machines are compiled from the tokenizer file.

* The splitter reads one symbol per character (its class, with the look-ahead of the split pattern folded in) and tells where
  a pre-token starts. All texts of a slice are cut into equal chunks; for every chunk its state map (entry state to exit
  state) is computed for all entry states at once, the maps compose through a parallel prefix scan, and the entry states
  found so give the starts inside every chunk.
* The merge transducer reads the bytes of a pre-token. Its transitions carry the change in the number of tokens that BPE
  gives for the bytes read so far. A state is the longest suffix of the input that can still grow into a vocabulary entry,
  with, for each place inside it, the last token of the encoding that ends there and its count relative to now. States are
  determinised as they are met, and shared by all texts that a worker reads.

What composes in the scan are the state maps of the splitter. Pre-tokens are independent of each other, so the merge transducer runs once
for each distinct one, emits its count, and the counts of all pre-tokens of a text are added up; a map of the transducer over a
chunk for all of its thousands of states would cost more than that sum. Memory is bounded: pre-tokens of over LONGEST characters
aren't remembered, and the transducer forgets its states, but for the one it is in, when it has too many.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from streamloom.llm.common import id_and_text, per_batch, read, safe_pieces

SLICE_CHARS = 1_000_000
CHUNK = 128
CACHED = 400_000
LONGEST, BLOCK = 64, 1 << 16

# Symbols of the splitter.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_LAST, GAP_LAST, GAP, CUT = range(9)
# States of the splitter: what the pre-token being read is made of.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, AFTER_SPACE, ONE_LEFT, TWO_LEFT, FRESH = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state] of the split pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    QUOTE1/QUOTE2: an apostrophe that begins a contraction of one or two letters. SPACE_LAST/GAP_LAST: the space, or other
    white space, right before a non-space character; GAP: white space elsewhere. CUT: the end of a text.
    """
    step, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), np.uint8)
    for symbol, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        step[symbol] = own
        starts[symbol, [own, AFTER_SPACE]] = 0
    step[LETTER, TWO_LEFT], step[LETTER, ONE_LEFT] = ONE_LEFT, FRESH
    starts[LETTER, [TWO_LEFT, ONE_LEFT]] = 0
    for symbol, then in ((QUOTE1, ONE_LEFT), (QUOTE2, TWO_LEFT)):
        step[symbol] = then
        step[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        starts[symbol, [IN_OTHERS, AFTER_SPACE]] = 0
    step[SPACE_LAST], step[GAP_LAST], step[GAP], step[CUT] = AFTER_SPACE, FRESH, IN_GAP, FRESH
    starts[GAP, IN_GAP] = 0
    return step, starts


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space (GAP) or other."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", GAP)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = symbol
    table[0xD800:0xE000] = OTHER
    return table


def _symbols(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """points: code points, with a stand-in at each place of cuts, where a text ends."""
    out = _classes()[points]
    out[cuts] = CUT
    gap = np.flatnonzero(out == GAP)
    follows = out[np.minimum(gap + 1, len(out) - 1)]
    last = (follows != GAP) & (follows != CUT)
    out[gap[last]] = np.where(points[gap[last]] == 0x20, SPACE_LAST, GAP_LAST)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        one = np.where(quotes + 1 < len(points), points[np.minimum(quotes + 1, len(points) - 1)], 0)
        two = np.where(quotes + 2 < len(points), points[np.minimum(quotes + 2, len(points) - 1)], 0)
        one[out[np.minimum(quotes + 1, len(points) - 1)] == CUT] = 0
        two[out[np.minimum(quotes + 2, len(points) - 1)] == CUT] = 0
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        e, l_ = ord("e"), ord("l")
        out[quotes[((one == ord("r")) | (one == ord("v"))) & (two == e) | (one == l_) & (two == l_)]] = QUOTE2
    return out


def pretoken_starts(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Places where a pre-token starts; a place of cuts always is one."""
    step, starts = _splitter()
    symbols = _symbols(points, cuts)
    n_states, n = step.shape[1], len(symbols)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, CUT, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.intp) * n_states
    flat_step, flat_starts = step.ravel(), starts.ravel()
    maps = np.tile(np.arange(n_states, dtype=np.uint8), (rows, 1))  # entry state to exit state of each chunk
    for row in grid:
        maps = flat_step[row[:, None] + maps]
    reach = 1
    scanned = maps
    while reach < rows:  # inclusive prefix scan: each map becomes the composition of all up to it
        later = scanned.copy()
        later[reach:] = np.take_along_axis(scanned[reach:], scanned[:-reach].astype(np.intp), axis=1)
        scanned, reach = later, reach * 2
    state = np.full(rows, FRESH, np.uint8)
    state[1:] = scanned[:-1, FRESH]
    found = np.empty((CHUNK, rows), np.uint8)
    for k, row in enumerate(grid):
        at = row + state
        found[k] = flat_starts[at]
        state = flat_step[at]
    return np.flatnonzero(found.T.ravel()[:n])


class MergeTransducer:
    """Token counts of byte strings, one byte a step. run() adds up what the transitions emit.

    Every encoding of a prefix is the encoding of a shorter prefix plus one token, and that token is the only one that
    BPE keeps apart from the token before it. So a state needs, for each place from which a vocabulary entry can still be
    under way, the last token there and the count there relative to now.
    """

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        self.vocab, self.merges = vocab, merges
        self.open = {token[:k] for token in vocab for k in range(len(token))}  # can grow into a longer entry
        self.pair_rank = {vocab[a] << 20 | vocab[b]: rank for (a, b), rank in merges.items()}
        self.rank = {a + b: rank for (a, b), rank in merges.items()}
        self.halves = {a + b: (a, b) for a, b in merges}
        self.spines: dict[int, tuple[tuple, tuple] | None] = {}
        self.fits: dict[int, bool] = {}
        self.names = {i: t for t, i in vocab.items()}
        self._reset()

    def _reset(self) -> None:
        start = (b"", ((0, -1, 0),))
        self.ids: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.steps: dict[int, tuple[int, int]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short byte string."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.merges.get(p, 1 << 60))
            if best not in self.merges:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def spine(self, token: bytes) -> tuple[tuple, tuple] | None:
        """The entries that stand at the left and at the right edge while BPE builds token, each with the rank of the merge
        that ends it; None if BPE never builds token."""
        if self.merged(token) != [token]:
            return None
        edges = []
        for side in (0, 1):
            own, until, edge = token, 1 << 60, []
            while True:
                edge.append((self.vocab[own], until))
                if own not in self.halves:
                    break
                own, until = self.halves[own][side], self.rank[own]
            edges.append(tuple(edge))
        return tuple(edges)

    def accepts(self, before: int, token: int) -> bool:
        """Whether an encoding that ends in `before` (-1: nothing) can go on with token: no merge across their border comes
        before the merges that build them (of equal merges the left one goes first)."""
        for i in (before, token):
            if i not in self.spines:
                self.spines[i] = None if i < 0 else self.spine(self.names[i])
        own = self.spines[token]
        if own is None or before < 0:
            return own is not None
        get = self.pair_rank.get
        for x, x_until in self.spines[before][1]:
            x <<= 20
            for y, y_until in own[0]:
                m = get(x | y)
                if m is not None and m < x_until and m <= y_until:
                    return False
        return True

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """Add the transition. A state is (tail, places): tail, the longest suffix that can grow into a longer entry;
        places, for each such suffix, longest first, (its length, the last token before it, the count there less now)."""
        tail, places = self.states[state]
        grown = tail + bytes((byte,))
        ids, open_, fits, found, kept = self.vocab, self.open, self.fits, -1, []
        for length, before, less in places:
            suffix = grown[-length - 1 :]
            if found < 0 and (token := ids.get(suffix)) is not None:
                key = before << 20 | token
                fit = fits.get(key)
                if fit is None:
                    fit = fits[key] = self.accepts(before, token)
                if fit:
                    found, emitted = token, less + 1
            if suffix in open_:
                kept.append((length + 1, before, less))
        if found < 0:
            raise ValueError("the vocabulary lacks a single byte")
        key = (grown[-kept[0][0] :] if kept else b"", (*((n, t, c - emitted) for n, t, c in kept), (0, found, 0)))
        target = self.ids.get(key)
        if target is None:
            target = self.ids[key] = len(self.states)
            self.states.append(key)
        self.steps[state << 8 | byte] = to = target, emitted
        return to

    def run(self, data: bytes) -> int:
        state = count = 0
        for at in range(0, len(data), BLOCK):
            get, compile_ = self.steps.get, self._compile
            for byte in data[at : at + BLOCK]:
                state, emitted = get(state << 8 | byte) or compile_(state, byte)
                count += emitted
            if len(self.steps) > 2 * CACHED or len(self.fits) > 8 * CACHED:
                state = self._forget(state)
        return count

    def _forget(self, state: int) -> int:
        """Forget all states but this one, which gets a new number."""
        key = self.states[state]
        self._reset()
        self.fits.clear()
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        return self.ids[key]


class _Counts(dict):
    """Counts of the pre-tokens met so far; a memo, emptied when full."""

    def __init__(self, machine: MergeTransducer):
        self.machine = machine

    def __missing__(self, piece: str) -> int:
        n = self.machine.run(piece.encode())
        if len(piece) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def compiled(path: str) -> tuple[_Counts, str]:
    """The machine of a byte-level BPE tokenizer file, and the pattern of its special strings ('' if none)."""
    import re

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind, model = spec["pre_tokenizer"], spec["model"]
    plain = kind["type"] == "ByteLevel" and not kind["add_prefix_space"] and kind.get("use_regex", True) and spec["normalizer"] is None
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: only plain byte-level BPE files can be compiled")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    raw = lambda s: bytes(to_byte[c] for c in s)
    special = [t["content"] for t in spec["added_tokens"] if t["special"]]
    vocab = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return _Counts(MergeTransducer(vocab, {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)})), "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))


def count_tokens(texts: list[str], path: str) -> list[int]:
    """The number of tokens of each text; a special string inside a text is one token."""
    import re

    counts, special = compiled(path)
    total = np.zeros(len(texts), np.int64)
    pieces, owners = [], []
    for i, text in enumerate(texts):
        parts = [text]
        if special and re.search(special, text):
            parts = re.split(special, text)
            total[i] += len(parts) - 1
        for part in parts:
            for piece in safe_pieces(part, SLICE_CHARS):
                if piece:
                    pieces.append(piece)
                    owners.append(i)
    at = 0
    while at < len(pieces):
        size, end = 0, at
        while end < len(pieces) and (end == at or size + len(pieces[end]) <= SLICE_CHARS):
            size += len(pieces[end]) + 1
            end += 1
        _count_slice(pieces[at:end], np.array(owners[at:end]), counts, total)
        at = end
    return total.tolist()


def _count_slice(pieces: list[str], owners: np.ndarray, counts: _Counts, total: np.ndarray) -> None:
    joined = "\n".join(pieces) + "\n"
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    cuts = np.cumsum(lengths + 1) - 1
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = pretoken_starts(points, cuts)
    ends = np.append(starts[1:], len(points))
    real = np.ones(len(points), bool)
    real[cuts] = False
    real = real[starts]
    starts, ends = starts[real], ends[real]
    n = np.fromiter(map(counts.__getitem__, [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64, len(starts))
    np.add.at(total, owners, np.bincount(np.searchsorted(cuts, starts), weights=n, minlength=len(pieces)).astype(np.int64))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row; a null or empty text counts 0."""

    def compute(texts: list[str]) -> dict:
        n = count_tokens(texts, path)
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return per_batch(id_and_text(docs, id_col, text_col), compute, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
