"""BPE encoding without merge loops, and decoding through an offset table.

The encoder reads a public tokenizer file (its vocabulary, merges, special tokens). A word is
scanned once with an Aho-Corasick automaton of all tokens, which gives the longest token at every
position. Tokens are then laid left to right; a token may follow another only if the pair would
survive the merges (the pair-compatibility table), and a dead end is undone by taking the next
shorter token. Each position is given up at most once, so the work is linear in the word, and the
result equals that of the merges.

Words repeat, so a task remembers the ids of recent words. Text is cut at ASCII blanks and line ends
for that: no token and no normalisation step of this tokenizer kind reaches across them.

Supported files: BPE with word-end suffix; NFC, white space and lower-case normalisation; a split
pattern; byte-level characters. Anything else is refused.

Defined results: NULL text encodes as empty text, and empty text to no ids; NULL ids decode to empty
text, unknown ids to nothing; special tokens written in a text become their ids, as the tokenizers
library does; extra columns stay, except those the operator adds.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shelfmark.llm.common import limit_batches

WORD_CACHE = 500_000  # words, and pieces of text, whose ids a worker remembers
PAIR_CACHE = 1_000_000  # token pairs whose compatibility a worker remembers
_END = 0xE000         # added to a character's code to mark it as the last of its word


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


# A full stop or comma behind another symbol belongs to the same word of symbols (İ ends in one
# once it is lower-cased).
_SYMBOL_BEFORE = re.compile(r"(?:[^\w\s]|[_İ\x1c-\x1f])[.,][ \n]")


def cut(text: str | None) -> list[str]:
    """Pieces of a text that are encoded each for itself, with the same ids as the whole.

    Words end at blanks, and between a letter or digit and a symbol; so a closing full stop or
    comma is cut off, unless some symbol comes before one. ASCII text is lower-cased here already,
    unless it may hold a special token. All this only makes more pieces equal.
    """
    text = (text or "").replace("\n", " ")
    if text.isascii() and "<|" not in text:
        text = text.lower()
    if not _SYMBOL_BEFORE.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")


class Recent(dict):
    """Remembers what ``make`` gave for the first ``size`` keys.

    Starts anew once as many further keys have been asked for, so that it follows the texts.
    """

    def __init__(self, make, size: int = WORD_CACHE):
        super().__init__()
        self.make, self.size, self.missed = make, size, 0

    def __missing__(self, key):
        value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) < self.size:
            self[key] = value
            return
        self.missed += 1
        if self.missed >= self.size:
            self.missed = 0
            self.clear()


class Vocabulary:
    """A tokenizer file: tokens, the two parts of each merged token, special tokens, pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        kinds = [s["type"] for s in steps], [s["type"] for s in spec["pre_tokenizer"]["pretokenizers"]]
        if (model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or spec["decoder"]
                or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])):
            raise ValueError(f"{path}: not a BPE file of the supported kind")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # White space as the file's own engine reads \s; other libraries add control characters.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.names = [""] * self.size
        for name, i in [*ids.items(), *self.special.items()]:
            self.names[i] = name
        self.symbols: list[str | None] = [None] * self.size
        for c in byte_characters():
            self.symbols[ids[c]] = c
            self.symbols[ids[c + "</w>"]] = chr(_END + ord(c))
        self.parts = [(i, i) for i in range(self.size)]
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = (ids[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            token = ids["".join(merge.split(" ") if isinstance(merge, str) else merge)]
            self.parts[token], self.pairs[left, right] = (left, right), token
            self.symbols[token] = self.symbols[left] + self.symbols[right]


class Encoder:
    """Texts to id arrays."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        by_symbols = {s: i for i, s in enumerate(v.symbols) if s is not None}
        self.automaton = ahocorasick.Automaton()
        for s, i in by_symbols.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.length = [len(s or "") for s in v.symbols]
        self.shorter = [-1] * v.size  # the longest token that begins a token
        for s, i in by_symbols.items():
            self.shorter[i] = next((by_symbols[s[:n]] for n in range(len(s) - 1, 0, -1)
                                    if s[:n] in by_symbols), -1)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.special = re.compile("|".join(map(re.escape, v.special)) or r"(?!)")
        self.character = byte_characters()
        self.words = Recent(self._word_bytes)
        self.pieces = Recent(self.piece)

    def _fits(self, first: int, second: int) -> bool:
        """Whether ``first`` and ``second`` side by side are what the merges leave there.

        Undoes the later of the two tokens again and again; if two neighbours at the seam form a
        merge that comes before the one just undone, the merges would have taken it.
        """
        known = self.compatible.get((first, second))
        if known is None:
            a, b, before, parts, pairs = first, second, 1 << 62, self.vocabulary.parts, \
                self.vocabulary.pairs
            known = True
            while True:
                if pairs.get((a, b), before) < before:
                    known = False
                    break
                whole_a, whole_b = parts[a][0] == a, parts[b][0] == b
                if whole_a and whole_b:
                    break
                if whole_b or (not whole_a and a > b):
                    before, a = a, parts[a][1]
                else:
                    before, b = b + 1, parts[b][0]
            if len(self.compatible) >= PAIR_CACHE:
                self.compatible.clear()
            self.compatible[first, second] = known
        return known

    def word(self, symbols: str) -> list[int]:
        """Ids of one word whose last symbol carries the end mark."""
        n = len(symbols)
        longest = [-1] * n
        for end, (size, token) in self.automaton.iter(symbols):
            longest[end - size + 1] = token  # ends only grow, so the last one is the longest
        length, shorter, fits = self.length, self.shorter, self._fits
        open_at = bytearray([1]) * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if open_at[end] and (last < 0 or fits(last, token)):
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    token = longest[at]
                    break
                token = shorter[token]
                if token < 0:  # dead end: give this position up and shorten the token before
                    open_at[at] = 0
                    out.pop()
                    at -= length[last]
                    token = last
                    token = shorter[token]
                    while token < 0:
                        open_at[at] = 0
                        back = out.pop()
                        at -= length[back]
                        token = shorter[back]
                    last = out[-1] if out else -1

    def piece(self, piece: str) -> bytes:
        """Ids of a text without blanks, as little-endian 32-bit numbers."""
        out, at = [], 0
        for found in self.special.finditer(piece):
            out.append(self._plain(piece[at:found.start()]))
            out.append(np.int32(self.vocabulary.special[found.group()]).tobytes())
            at = found.end()
        out.append(self._plain(piece[at:]))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # lower-case each character for itself: no special form for a last sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__,
                            self.vocabulary.pattern.findall(text.lower())))

    def _word_bytes(self, word: str) -> bytes:
        chars = [self.character[b] for b in word.encode("utf-8", "replace")]
        chars[-1] = chr(_END + ord(chars[-1]))
        return np.array(self.word("".join(chars)), "<i4").tobytes()

    def text(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian 32-bit numbers."""
        return b"".join(map(self.pieces.__getitem__, cut(text)))


_encoders: dict[str, Encoder] = {}  # of this worker process, kept from task to task


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path))
    return _encoders[path]


class Decoder:
    """Id arrays to texts: all token names in one byte string, found through an offset table."""

    def __init__(self, vocabulary: Vocabulary):
        names = [f"{n} ".encode() if n else b"" for n in vocabulary.names]
        self.offsets = np.concatenate([[0], np.cumsum([len(n) for n in names])])
        self.names = np.frombuffer(b"".join(names), np.uint8)

    def texts(self, values: np.ndarray, starts: np.ndarray) -> pa.Array:
        """Texts of the lists that ``starts`` cuts ``values`` into."""
        sizes = np.diff(starts)
        row = np.repeat(np.arange(len(sizes)), sizes)
        known = (values >= 0) & (values < len(self.offsets) - 1)
        values, row = values[known], row[known]
        begin = self.offsets[values]
        size = self.offsets[values + 1] - begin
        ends = np.cumsum(size)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        out = self.names[source]
        total = np.bincount(row, size, len(sizes)).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(total)])
        keep = np.ones(len(out), bool)
        keep[cut[1:][total > 0] - 1] = False  # no blank behind the last token
        cut = np.concatenate([[0], np.cumsum(np.maximum(total - 1, 0))])
        return pa.LargeStringArray.from_buffers(
            len(sizes), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(out[keep].tobytes()))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids",
           drop_text: bool = False) -> DataFrame:
    """``docs`` and the ids of ``text`` as array<int>; ``path`` is a file that every task can read."""
    source = docs.drop(ids) if ids in docs.columns and ids != text else docs
    kept = [c for c in source.columns if c != text or not drop_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            found = [encoder.text(t.as_py()) for t in batch.column(text)]
            cut = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(cut), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists],
                                             [*kept, ids])

    limit_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields
                       if f.name in kept)
    return source.mapInArrow(run, f"{fields}, `{ids}` array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` and the text of ``ids``, token names with a blank between them."""
    source = rows.drop(text) if text in rows.columns else rows
    kept = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary(path))
        for batch in batches:
            lists = batch.column(ids)
            values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            found = decoder.texts(values.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, found.cast(pa.string())],
                                             [*kept, text])

    limit_batches(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{fields}, `{text}` string")
