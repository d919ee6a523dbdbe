"""Token counts by finite-state transducers, without running the tokenizer library.

Two deterministic transducers annotate their transitions with what they emit:

* the *splitter* reads character classes of a normalised text and emits a mark where a
  pre-token starts. Texts of a batch are laid end to end and cut into chunks of equal
  length. Each chunk's state map (for every state it may be entered in, the state it is
  left in) is computed for all chunks at once; a parallel prefix scan composes the maps,
  which gives each chunk's entry state, and a second pass emits the marks.
* the *merger* reads the symbols of one pre-token and emits the change in the number of
  tokens. It is compiled from the merge list on demand: a state is the tokenisation's
  live tail (for each suffix that can still grow into a token, the last token before it
  and how many tokens it would save), so that pre-tokens with the same tail share states
  and transitions.

The merger rests on a property of merge lists: a sequence of tokens is the encoding of
its text exactly if every neighbouring pair is the encoding of its own text. The last
token of each prefix's encoding is therefore unique, and the number of tokens of a prefix
is one more than that of the prefix before its last token.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Code points in a chunk of the splitter.
CHUNK = 256
#: Code points laid end to end at once: bounds a worker's memory.
BLOCK = 1 << 20
#: States and memoised pre-tokens a worker keeps before it starts afresh.
MEMO = 200_000

# Character classes of the splitter; the quote classes look ahead (fixed values).
SPACE, LETTER, NUMBER, OTHER, QUOTE2, QUOTE3 = range(6)
# States: after a space or at the start, in letters, after a digit, in other characters,
# and in a contraction with one or two letters to come (fixed values).
S_SPACE, S_LETTER, S_NUMBER, S_OTHER, S_LAST, S_TWO, S_DONE = range(7)
N_STATES, N_CLASSES = 7, 6
SHORT_TAILS, LONG_TAILS = ("s", "t", "m", "d"), ("re", "ve", "ll")


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and mark[state, class] of the splitter."""
    nxt = np.zeros((N_STATES, N_CLASSES), np.uint8)
    mark = np.zeros((N_STATES, N_CLASSES), bool)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            if s == S_TWO:
                nxt[s, c] = S_LAST
            elif s == S_LAST:
                nxt[s, c] = S_DONE
            elif c == SPACE:
                nxt[s, c] = S_SPACE
            elif c == LETTER:
                nxt[s, c], mark[s, c] = S_LETTER, s != S_LETTER
            elif c == NUMBER:
                nxt[s, c], mark[s, c] = S_NUMBER, True
            elif c == OTHER or s == S_OTHER:
                nxt[s, c], mark[s, c] = S_OTHER, s != S_OTHER
            else:
                nxt[s, c], mark[s, c] = (S_LAST if c == QUOTE2 else S_TWO), True
    return nxt, mark


def class_table() -> np.ndarray:
    """The class of each code point, from the Unicode properties of the pattern."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        for m in regex.finditer(name + "+", every):
            first, last = ord(m[0][0]), ord(m[0][-1])
            table[first : last + 1] = c
    return table


def classes(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes with the quotes' look-ahead resolved."""
    out = table[points]
    at = np.flatnonzero(points == ord("'"))
    if at.size:
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        out[at[np.isin(one, [ord(c) for c in SHORT_TAILS])]] = QUOTE2
        for a, b in LONG_TAILS:
            out[at[(one == ord(a)) & (two == ord(b))]] = QUOTE3
    return out


def entry_states(chunks: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """The state in which each chunk (a column of ``chunks``) is entered, by a prefix scan of state maps."""
    flat, n = nxt.ravel(), chunks.shape[1]
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], n, axis=1)
    for row in chunks:
        if len(maps) > 1 and (maps == maps[0]).all():  # all maps are constant by now: one row tells all
            maps = maps[:1]
        maps = flat[maps * np.uint8(N_CLASSES) + row]
    maps = np.broadcast_to(maps, (N_STATES, n))
    step = 1
    while step < n:  # maps[:, k] becomes the map of chunks 0..k
        composed = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
        maps = np.concatenate([maps[:, :step], composed], axis=1)
        step *= 2
    return np.concatenate([[S_SPACE], maps[S_SPACE, :-1]]).astype(np.uint8)


class Merger:
    """Counts the tokens of one pre-token; compiled lazily from a merge list."""

    def __init__(self, model: dict):
        self.end = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.tokens = set(model["vocab"])
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {(("", "", 0),): 0}
        self.states: list[tuple] = [(("", "", 0),)]
        self.arcs: dict[tuple[int, str], tuple[int, int]] = {}

    def encode(self, symbols: list[str]) -> list[str]:
        """The merge list applied to symbols: lowest rank first, leftmost first."""
        s = list(symbols)
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: (self.rank.get((s[i], s[i + 1]), 1 << 30), i))
            if (s[best], s[best + 1]) not in self.rank:
                break
            s[best : best + 2] = [s[best] + s[best + 1]]
        return s

    def symbols(self, text: str) -> list[str]:
        """Symbols of a token's text; its last one carries the word end."""
        if self.end and text.endswith(self.end):
            body = text[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(text)

    def whole(self, token: str) -> bool:
        """Whether the merge list makes this token of its own text."""
        if token not in self.known:
            self.known[token] = token in self.tokens and self.encode(self.symbols(token)) == [token]
        return self.known[token]

    def fits(self, a: str, b: str) -> bool:
        """Whether the text of a and b together is encoded as a, b."""
        if not a:
            return True
        if (a, b) not in self.pairs:
            if len(self.pairs) > 4 * MEMO:
                self.pairs.clear()
            self.pairs[a, b] = self.encode([*self.symbols(a), *self.symbols(b)]) == [a, b]
        return self.pairs[a, b]

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """The next state and the change in the number of tokens.

        A state lists (tail, last, less): for each tail that begins a token, the last
        token of the encoding before it and how many tokens fewer that encoding has.
        """
        arc = self.arcs.get((state, symbol))
        if arc is None:
            found = None
            for tail, last, less in self.states[state]:  # longest tail first
                token = tail + symbol
                if token in self.tokens and self.whole(token) and self.fits(last, token):
                    found = token, 1 - less
                    break
            if found is None:  # no vocabulary entry: the library drops the symbol
                found = "", 0
            token, delta = found
            live = [(t + symbol, last, less + delta) for t, last, less in self.states[state] if t + symbol in self.prefixes]
            new = (*live, ("", token, 0))
            if new not in self.ids:
                self.ids[new] = len(self.states)
                self.states.append(new)
            arc = self.arcs[state, symbol] = self.ids[new], delta
        return arc

    def count(self, symbols: list[str]) -> int:
        if len(self.arcs) > MEMO:
            self.clear()
        state = n = 0
        for symbol in symbols:
            state, delta = self.step(state, symbol)
            n += delta
        return n


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    at = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [at[b] for b in range(256)]


def normalise(text: str) -> str:
    """NFC, every run of white space one space, lower case letter by letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


# The steps around the merge list that the splitter and ``normalise`` stand for.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_supported(d: dict) -> None:
    """Raises for a tokenizer file whose counts these transducers would get wrong."""
    model, steps = d.get("model") or {}, (d.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split, level = (steps + [{}, {}])[:2]
    wrong = {
        "normalizer": (d.get("normalizer") or {}).get("normalizers") != NORMALIZER,
        "pre-tokenizer": len(steps) != 2
        or (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) != ("Split", {"Regex": SPLIT_PATTERN}, "Removed", True)
        or (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) != ("ByteLevel", False, False),
        "model": model.get("type") != "BPE" or not model.get("end_of_word_suffix") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "added tokens": any(t.get(k) for t in d.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if any(wrong.values()):
        raise ValueError(f"not compiled for this tokenizer file: {', '.join(k for k, v in wrong.items() if v)}")


class Compiled:
    """Both transducers for one tokenizer file, with a memo of pre-tokens."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        check_supported(d)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in d["added_tokens"])) if d["added_tokens"] else None
        #: A character that stands in every special string: texts without it need no search.
        self.mark_of_special = min(set.intersection(*[set(t["content"]) for t in d["added_tokens"]]), default="") if d["added_tokens"] else ""
        self.merger = Merger(d["model"])
        self.nxt, self.mark = splitter()
        self.table = class_table()
        self.bytes = byte_symbols()
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.memo.get(word)
        if n is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            s = [self.bytes[b] for b in word.encode()]
            s[-1] += self.merger.end
            n = self.memo[word] = self.merger.count(s)
        return n

    def marks(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens start, and where text is no white space."""
        c = classes(points, self.table)
        n = -(-c.size // CHUNK)
        chunks = np.full(n * CHUNK, SPACE, np.uint8)
        chunks[: c.size] = c
        chunks = np.ascontiguousarray(chunks.reshape(n, CHUNK).T)
        state, starts = entry_states(chunks, self.nxt), np.empty_like(chunks, bool)
        nxt, mark = self.nxt.ravel(), self.mark.ravel()
        for i, row in enumerate(chunks):
            at = state * np.uint8(N_CLASSES) + row
            starts[i], state = mark[at], nxt[at]
        return starts.T.ravel()[: c.size], c != SPACE

    def count_block(self, texts: list[str]) -> np.ndarray:
        """Tokens of each normalised text without special strings."""
        joined = " ".join(texts) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, solid = self.marks(points)
        first = np.flatnonzero(starts)
        # A pre-token ends where the next one starts or at the first white space after it.
        stop = np.flatnonzero(starts | ~solid)
        end = np.append(stop, points.size)[np.searchsorted(stop, first, side="right")]
        word = self.word
        get = self.memo.get
        counts = np.fromiter(((get(w) or word(w)) for w in (joined[a:b] for a, b in zip(first.tolist(), end.tolist()))), np.int64, first.size)
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        sums = np.concatenate([[0], np.cumsum(counts)])
        at = np.searchsorted(first, bounds)
        return sums[at[1:]] - sums[at[:-1]]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts: list[str] = []
        owner: list[int] = []
        out = np.zeros(len(texts), np.int64)
        size = 0
        for i, text in enumerate(texts):
            pieces = [text]
            if self.special is not None and self.mark_of_special in text:
                pieces = self.special.split(text)
                out[i] += len(pieces) - 1
            for p in pieces:
                p = normalise(p)
                parts.append(p)
                owner.append(i)
                size += len(p)
            if size >= BLOCK:
                np.add.at(out, owner, self.count_block(parts))
                parts, owner, size = [], [], 0
        if parts:
            np.add.at(out, owner, self.count_block(parts))
        return out


@functools.lru_cache(maxsize=1)
def compiled(spec: str) -> Compiled:
    """One per worker process: tasks after the first find its states and memo warm."""
    return Compiled(spec)


def token_counts(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens`` of every row; ``spec`` is the tokenizer file's text.

    Counts are those of the library without begin, end or added special tokens; a
    special token's string inside a text counts as one token. Null text counts as
    empty: no bytes, no tokens. Other columns are ignored. A file with other normalising
    or splitting steps, or another kind of model, is refused with a ValueError.
    """
    check_supported(json.loads(spec))
    held = docs.sparkSession.sparkContext.broadcast(spec)
    id_type = docs.schema[id_col].dataType

    def run(batches):
        transducers = compiled(held.value)
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            n = pa.array(transducers.count(texts), pa.int64()) if texts else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["id", "n_bytes", "n_tokens"])

    raw = docs.select(F.col(id_col).alias("id"), text_bytes(docs, text_col).alias("t")).withColumn("n", F.octet_length("t").cast("long"))
    return raw.mapInArrow(run, f"id {id_type.simpleString()}, n_bytes long, n_tokens long")
