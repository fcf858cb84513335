"""BPE encoding by backtracking, and decoding by an offset table.

Encoding a word: an Aho-Corasick automaton over the vocabulary finds the longest token at every position. Tokens are taken
from left to right; one may follow another only if the merges, applied to the two together, would give exactly these two
(a table of pairs, filled as pairs are met). Where none fits, the last token gives way to its next shorter prefix and the
position is marked dead, so each is left at most once and the time is linear. A sequence in which all neighbours are
compatible is the one that the merges produce.

Neither a token nor a normalisation reaches across white space, so the ids of a run without white space are remembered
whole. The memory of a worker is bounded; runs forgotten are encoded again.

Text is normalised by Python's Unicode tables. The tokenizers order combining marks by an older version, so where a mark that is newer than
theirs stands next to another mark the ids can differ.

Vocabulary files are those of word-level BPE with ends of words: read from a path that every executor has.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from jobharbor.llm.common import fresh, per_text

#: Entries a worker remembers, and the longest run of characters it remembers.
REMEMBERED, LONGEST = 500_000, 48
PAIRS = 500_000
#: Punctuation that ends a word and is one token string of its own there.
STOPS = frozenset(".,;:!?")
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: Python counts these as white space when it splits, Unicode doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Capitals that Unicode got after the version Python knows, with their small letters: first, last, distance.
LATE_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
                 (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
#: Letters and numbers of that version (16.0), first and last. What neither version has is no letter to the tokenizers.
LATE_WORDS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85),
              (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
              (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
              (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9),
              (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA))
LATE = {c: c + by for first, last, by in LATE_CAPITALS for c in range(first, last + 1)}
#: Stands for a character that Unicode has not assigned: neither letter nor number nor space.
UNASSIGNED = "\ue000"
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


def _late(code: int) -> bool:
    return any(first <= code <= last for first, last in LATE_WORDS)


class OffsetTable:
    """Strings laid end to end; looking up many numbers is one gather."""

    def __init__(self, strings: list[bytes]):
        self.blob = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, ids: np.ndarray, step: int = 1 << 15) -> bytes:
        return b"".join(self._join(ids[at : at + step]) for at in range(0, len(ids), step))

    def _join(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.blob[shift + np.arange(ends[-1])].tobytes()


class _Runs(dict):
    """Ids of runs without white space, as little-endian bytes. Half of what is remembered goes when it is full: what
    was not asked for since the last time."""

    def __init__(self, encode):
        self.encode = encode
        self.most = REMEMBERED
        self.older: dict[str, bytes] = {}

    def __missing__(self, run: str) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            ids = self.encode(run)
        if len(run) <= LONGEST:
            self.keep(run, ids)
        return ids

    def keep(self, run: str, ids: bytes) -> None:
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[run] = ids

    def known(self, run: str) -> bytes | None:
        return self.get(run) or self.older.get(run)


class _Anything(dict):
    def get(self, key, default=None):
        return True


class WordBpe:
    """Symbols are bytes, plus 256 for the last byte of a word; tokens are numbered as they are merged."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        if model["type"] != "BPE" or not end or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("not a vocabulary of words with ends")
        vocabulary: dict[str, int] = model["vocab"]
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}

        def symbols(token: str) -> str:
            last = token.endswith(end) and len(token) > len(end)
            body = [byte_of[c] for c in (token[: -len(end)] if last else token)]
            return "".join(map(chr, [*body[:-1], body[-1] + 256 * last]))

        names = [*characters, *(c + end for c in characters)]
        number = {n: i for i, n in enumerate(names)}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(names))]
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if left + right in number:
                raise ValueError("two merges give one token")
            number[left + right] = len(names)
            self.merged[number[left], number[right]] = len(names)
            self.parts.append((number[left], number[right]))
            names.append(left + right)
        self.spelt = [symbols(n) for n in names]
        self.by_spelling = {s: i for i, s in enumerate(self.spelt)}
        self.ids = [vocabulary[n] for n in names]
        self.sizes = [len(s) for s in self.spelt]
        # only tokens that the merges make of their own spelling can ever be part of a result; parts come before wholes
        self.whole: list[bool] = []
        for token, (left, right) in enumerate(self.parts):
            self.whole.append(left == token or self.whole[left] and self.whole[right] and self._apart(left, right, token))
        self.found = ahocorasick.Automaton()
        for i, s in enumerate(self.spelt):
            if self.whole[i]:
                self.found.add_word(s, (i, len(s) - 1))
        self.found.make_automaton()
        self.shorter = [self._next_shorter(s) for s in self.spelt]
        self.pairs: list[dict[int, bool]] = [{} for _ in self.spelt]  # by the left one of two neighbours
        self.pairs.append(_Anything())  # the start of a word goes with all
        self.known_pairs = 0

        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_first = {t[0] for t in self.added}
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("\\s", SPACES))
        self.spaces = re.compile(f"[{SPACES}]+")
        self.runs = _Runs(self._run)

        size = max(*self.ids, *self.added.values()) + 1
        shown = [b""] * size
        for name, i in [*zip(names, self.ids, strict=True), *self.added.items()]:
            shown[i] = name.encode() + b" "
        self.tokens = OffsetTable(shown)

    # --- encoding ---

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        cut = self.spaces.split(text) if any(c in text for c in SEPARATORS) else text.split()
        return np.frombuffer(b"".join(map(self.runs.__getitem__, cut)), dtype="<u4")

    def remember(self, most: int) -> None:
        """How many runs to remember from now on."""
        self.runs.most = most

    def forget(self) -> None:
        """Give back the memory of runs and pairs."""
        self.runs.clear()
        self.runs.older = {}
        for known in self.pairs[:-1]:
            known.clear()
        self.known_pairs = 0

    def _run(self, run: str) -> bytes:
        if self.special_first.isdisjoint(run):
            return self._piece(run)
        pieces = (p for p in self.special.split(run) if p)
        return b"".join(struct.pack("<I", self.added[p]) if p in self.added else self._piece(p) for p in pieces)

    def _piece(self, piece: str) -> bytes:
        # lower case of each character on its own, whatever stands beside it
        ascii_only = piece.isascii()
        plain = piece.lower() if ascii_only else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        if plain.isalpha():
            return self._word(plain)
        if plain[-1] in STOPS and plain[:-1].isalpha():
            return self._word(plain[:-1]) + self._word(plain[-1])
        if ascii_only:
            return b"".join(map(self._word, self.words.findall(plain)))
        # the pattern's library knows later versions of Unicode than the tokenizers do
        classed = "".join(UNASSIGNED if unicodedata.category(c) == "Cn" and not _late(ord(c)) else c for c in plain)
        spelt = plain.translate(LATE)
        return b"".join(self._word(spelt[m.start() : m.end()]) for m in self.words.finditer(classed))

    def _word(self, word: str) -> bytes:
        """A word is a run of its own, so both share one memory."""
        known = self.runs.known(word)
        if known is None:
            spelt = word if word.isascii() else word.encode().decode("latin-1")
            ids = self.ids
            tokens = [ids[t] for t in self._tokens(spelt[:-1] + chr(256 + ord(spelt[-1])))]
            known = PACK[len(tokens)](*tokens) if len(tokens) < len(PACK) else struct.pack(f"<{len(tokens)}I", *tokens)
            if len(word) <= LONGEST:
                self.runs.keep(word, known)
        return known

    def _tokens(self, spelt: str) -> list[int]:
        whole = self.by_spelling.get(spelt)
        if whole is not None and self.whole[whole]:
            return [whole]
        n = len(spelt)
        longest = [-1] * n
        for end, (token, before) in self.found.iter(spelt):
            longest[end - before] = token  # ends come in order, so the last is the longest
        sizes, shorter, pairs = self.sizes, self.shorter, self.pairs
        taken: list[int] = []
        dead = bytearray(n + 1)
        at, token, fits = 0, longest[0], pairs[-1]
        while True:
            end = at + sizes[token]
            if not dead[end]:
                fit = fits.get(token)
                if fit is None:
                    fit = self._fit(taken[-1], token)
                if fit:
                    taken.append(token)
                    if end == n:
                        return taken
                    at, fits, token = end, pairs[token], longest[end]
                    continue
            token = shorter[token]
            while token < 0:
                # nothing fits here: the last token gives way to a shorter one
                dead[at] = 1
                token = taken.pop()
                at -= sizes[token]
                fits = pairs[taken[-1] if taken else -1]
                token = shorter[token]

    def _next_shorter(self, spelt: str) -> int:
        """The longest proper prefix that is a token, or -1."""
        prefixes = (self.by_spelling.get(spelt[:k], -1) for k in range(len(spelt) - 1, 0, -1))
        return next((p for p in prefixes if p >= 0 and self.whole[p]), -1)

    def _fit(self, left: int, right: int) -> bool:
        if self.known_pairs >= PAIRS:
            for known in self.pairs[:-1]:
                known.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        known = self.pairs[left][right] = self._apart(left, right, len(self.parts))
        return known

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge earlier than ``limit`` joins symbols across the border of two tokens.

        The later-made of the two neighbours at the border is taken apart, step by step backwards in time;
        a merge across the border that comes before the step that made a neighbour would have come first.
        """
        merged, parts = self.merged, self.parts
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right and parts[left][0] != left:
                limit = left
                left = parts[left][1]
            elif parts[right][0] != right:
                limit = right + 1  # of equal merges the one further left comes first
                right = parts[right][0]
            elif parts[left][0] != left:
                limit = left
                left = parts[left][1]
            else:
                return True

    # --- decoding ---

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by spaces, in UTF-8: what a vocabulary without decoder gives."""
        return self.tokens.join(ids)[:-1] if len(ids) else b""


@functools.cache
def load(path: str) -> WordBpe:
    """One per worker."""
    return WordBpe(path)


def bpe_encode(rows: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Replace ``text`` by the column ``into``: the ids as array<int>. Null and empty texts give no ids.

    A column of that name is kept, the new one then gets a trailing underscore. Other columns pass through.
    """
    name = fresh(into, [c for c in rows.columns if c != text])

    def maker():
        bpe = load(path)
        return lambda texts: {name: [bpe.encode(t).astype(np.int32) for t in texts]}

    return per_text(rows, text, f"`{name}` array<int>", maker)


def bpe_decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Add the decoded text; null or no ids give the empty text. ``ids`` and the other columns stay."""
    import pyarrow as pa
    from pyspark.sql import types as T

    name = fresh(into, rows.columns)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                made = [bpe.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([m.decode() for m in made], type=pa.string())], names=[*part.schema.names, name]
                )

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))
