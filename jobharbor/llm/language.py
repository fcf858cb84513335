"""Language identification by bit-sliced Bloom filters of character n-grams.

All languages share one table of slots; bit l of a slot belongs to the filter of language l. The slots of an n-gram, combined by AND, give
a mask of all languages that contain it at once. A text counts, for each language, the n-grams whose mask has its bit, takes off
what the filter's fill makes it say by mistake, and the largest share decides.

An n-gram is in the filter of a language if it makes up a good part of the n-gram's use over all languages, each language
weighing the same. Counts are over all training texts.
"""

from __future__ import annotations

import re
import zlib
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobharbor.llm.common import fresh, per_text, slices, stored

SIZES = (2, 3, 4)
#: n-grams rarer than this, and those of which the language has less than its part of an even share, are not its own.
LEAST, PART = 5, 0.6
#: Slots for each n-gram of the largest filter and hashes of an n-gram; slots at most. Beyond that the filters fill up, for which the shares are corrected;
#: every n-gram is in its filters at any size.
SLOTS, HASHES, MOST = 12, 4, 1 << 22
REMEMBERED = 200_000
#: Runs of letters: what counts as a word character but is no digit, no underscore and no number of another kind.
NUMBERS = "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
LETTERS = re.compile(rf"[^\W\d_{NUMBERS}]+")
#: The same, but for numbers that are no digits: a small class of characters, which is searched many times faster.
RUNS = re.compile(r"[^\W\d_]+")
LANE = 40  # bits of a count
#: ASCII characters that are no letters end a piece of a text; all other bytes of UTF-8 stay.
_ENDS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
#: Letters whose n-grams are made at once, and letters of a word whose sum is remembered.
AT_ONCE, SHORT = 1 << 18, 64


def letter_runs(text: str) -> list[str]:
    """What ``LETTERS`` finds in a text; only runs that hold more than letters are searched with it."""
    found = RUNS.findall(text)
    if text.isascii():
        return found
    return [word for run in found for word in ((run,) if run.isalpha() else LETTERS.findall(run))]


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1)]


def pieces(text: str) -> list[bytes]:
    """A text in lower case, cut where an ASCII character is no letter. No run of letters is cut; a piece that isn't ASCII may hold several or none."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_ENDS).split()


def opened(found: list[bytes]) -> tuple[list[str], np.ndarray]:
    """The runs of letters in pieces, and for each run the place of its piece."""
    runs: list[str] = []
    of: list[int] = []
    for at, piece in enumerate(found):
        if piece.isascii():
            runs.append(piece.decode("ascii"))
            of.append(at)
        else:
            own = letter_runs(piece.decode("utf-8", "surrogatepass"))
            runs += own
            of += [at] * len(own)
    return runs, np.array(of, dtype=np.int64)


def all_grams(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different n-grams of words and, for every use of one, its place among them and the place of its word; what ``grams`` finds, for many words at once.

    Letters are numbered, so an n-gram is a number of 16 bits a letter.
    """
    points = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    numbered = pa.array(points).dictionary_encode()
    letters = numbered.dictionary.to_numpy()
    if len(letters) > 0xFFFF:
        found = [grams(word) for word in words]
        numbered = pa.array([gram for own in found for gram in own], type=pa.string()).dictionary_encode()
        return numbered.dictionary.to_pylist(), numbered.indices.to_numpy(), np.repeat(np.arange(len(words)), [len(own) for own in found])
    ids = numbered.indices.to_numpy().astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.cumsum(lengths)[word] - np.arange(len(word))
    keys, owners, key = [], [], ids
    for n in range(2, max(SIZES) + 1):
        key = (key[:-1] << np.uint64(16)) | ids[n - 1 :]
        if n in SIZES:
            whole = left[: len(key)] >= n
            keys.append(key[whole])
            owners.append(word[: len(key)][whole])
    numbered = pa.array(np.concatenate(keys)).dictionary_encode()
    different = numbered.dictionary.to_numpy()
    text = np.zeros((len(different), max(SIZES)), dtype="<u4")
    for n in SIZES:
        own = np.flatnonzero((different >> np.uint64(16 * (n - 1)) != 0) & (different >> np.uint64(16 * (n - 1)) <= 0xFFFF))
        for k in range(n):
            text[own, k] = letters[((different[own] >> np.uint64(16 * (n - 1 - k))) & np.uint64(0xFFFF)).astype(np.int64) - 1]
    return text.view(f"<U{max(SIZES)}").ravel().tolist(), numbered.indices.to_numpy(), np.concatenate(owners)


def in_parts(words: list[str]) -> Iterator[slice]:
    """Stretches of a list of words with about ``AT_ONCE`` letters; a longer word is one of its own."""
    first = held = 0
    for at, word in enumerate(words):
        if held and held + len(word) > AT_ONCE:
            yield slice(first, at)
            first, held = at, 0
        held += len(word)
    if words:
        yield slice(first, len(words))


def places(gram: str, slots: int) -> list[int]:
    raw = gram.encode("utf-8", "surrogatepass")
    first, step = zlib.crc32(raw), zlib.crc32(raw, 0x9E3779B9) | 1
    return [(first + i * step) % slots for i in range(HASHES)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # slots x words of 64 languages
    mistakes: list[float]  # each filter's rate of false positives


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with a text and a language; without any, the model knows no language."""
    counted = stored(_counts(rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))), "language-grams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row a language
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((1, 1), dtype=np.uint64), [])
    rates = counted.join(F.broadcast(counted.groupBy("lang").agg(F.sum("n").alias("total"))), "lang").withColumn("rate", F.col("n") / F.col("total"))
    even = rates.groupBy("gram").agg(F.sum("rate").alias("all"))
    own = rates.where(F.col("n") >= LEAST).join(even, "gram").where(F.col("rate") / F.col("all") >= PART / len(languages))
    own = stored(own.select("lang", "gram"), "language-own")
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}  # one row a language
    slots = min(MOST, 1 << (SLOTS * max(sizes.values(), default=1) - 1).bit_length())
    return _model(languages, slots, _bits(own, languages, slots))


def _bits(own: DataFrame, languages: list[str], slots: int) -> DataFrame:
    """The filters one behind the other as rows (_bucket, _bits) of 32,768 slots: as many as the filters have, whatever the number of n-grams."""
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        for batch in batches:
            base = [number[lang] * slots for lang in batch.column("lang").to_pylist()]
            made = [b + p + 1 for b, gram in zip(base, batch.column("gram").to_pylist(), strict=True) for p in places(gram, slots)]
            yield pa.RecordBatch.from_arrays([pa.array(made, type=pa.int64())], names=["place"])

    placed = own.mapInArrow(run, "place bigint")
    return placed.groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))


def _model(languages: list[str], slots: int, bits: DataFrame) -> Model:
    filters = np.zeros((len(languages) * slots + 32_767) // 32_768 * 4096, dtype=np.uint8)
    for row in bits.collect():  # bounded by the filters' size
        at = (row["_bucket"] - 1) * 4096
        filters[at : at + 4096] = np.frombuffer(row["_bits"], dtype=np.uint8)
    table = np.zeros((slots, -(-len(languages) // 64)), dtype=np.uint64)
    flags = np.unpackbits(filters, bitorder="little")
    fills = []
    for i in range(len(languages)):
        held = flags[i * slots : (i + 1) * slots]
        table[:, i // 64] |= held.astype(np.uint64) << np.uint64(i % 64)
        fills.append(float(held.mean()))
    return Model(languages, table, [fill**HASHES for fill in fills])


def _counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n. Words are counted first, then the n-grams of different words; memory of a task is bounded."""

    def run(batches):
        words: dict[str, Counter] = {}
        tallies: dict[str, dict[str, int]] = {}

        def fold():
            for lang, counts in words.items():
                tally = tallies.setdefault(lang, defaultdict(int))
                runs, of = opened(list(counts))
                times = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))[of]
                for part in in_parts(runs):
                    found, which, word = all_grams(runs[part])
                    for gram, n in zip(found, np.bincount(which, times[part][word], len(found)).tolist(), strict=True):
                        tally[gram] += int(n)
            words.clear()

        def out():
            for lang, tally in tallies.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(tally), type=pa.string()), pa.array(list(tally), type=pa.string()), pa.array(list(tally.values()), type=pa.int64())],
                    schema=schema,
                )
            tallies.clear()

        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for part in slices(batch.column("text")):
                for lang, text in zip(langs[at : at + len(part)], part, strict=True):
                    words.setdefault(lang, Counter()).update(pieces(text))
                at += len(part)
                if sum(map(len, words.values())) > REMEMBERED:
                    fold()
                if sum(map(len, tallies.values())) > REMEMBERED:
                    yield from out()
        fold()
        yield from out()

    return rows.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class _Grams(dict):
    """Counts of one n-gram side by side in one number: 1 in lane 0, and in lane l + 1 if it is in the filter of language l."""

    def __init__(self, table: np.ndarray, languages: int):
        self.slots = len(table)
        self.rows = [sum(int(x) << (64 * i) for i, x in enumerate(row)) for row in table.tolist()]
        self.spread = [1 << (LANE * (i + 1)) for i in range(languages)]

    def __missing__(self, gram: str) -> int:
        mask = -1
        for place in places(gram, self.slots):
            mask &= self.rows[place]
        value = 1
        while mask:
            low = mask & -mask
            value += self.spread[low.bit_length() - 1]
            mask ^= low
        if len(self) >= REMEMBERED:
            self.clear()
        self[gram] = value
        return value


class _Words(dict):
    """The sum over the n-grams of a piece of text, as numbers like those of ``_Grams``."""

    def __init__(self, table: np.ndarray, languages: int):
        self.grams, self.lanes = _Grams(table, languages), languages + 1
        self.long: list[bytes] = []

    def learn(self, found: set[bytes]) -> None:
        """Have the sums of these pieces. Others may be forgotten, and long ones are, so memory follows what is asked for at once."""
        for piece in self.long:
            self.pop(piece, None)
        new = [piece for piece in found if piece not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(found)
        self.long = [piece for piece in new if len(piece) > SHORT]
        sums = np.zeros((len(new), self.lanes), dtype="<i8")
        runs, of = opened(new)
        for part in in_parts(runs):
            different, which, word = all_grams(runs[part])
            values = b"".join(self.grams[gram].to_bytes(self.lanes * LANE // 8, "little") for gram in different)
            flags = np.frombuffer(values, dtype=np.uint8).reshape(len(different), self.lanes, LANE // 8)[:, :, 0]
            at = of[part]
            first, count, owner = at[0], at[-1] - at[0] + 1, (at - at[0])[word]
            for lane in range(self.lanes):
                sums[first : first + count, lane] += np.bincount(owner[flags[:, lane].astype(bool)[which]], minlength=count)
        raw, width = sums.view(np.uint8).reshape(len(new), self.lanes, 8)[:, :, : LANE // 8].tobytes(), self.lanes * LANE // 8
        for at, piece in enumerate(new):
            self[piece] = int.from_bytes(raw[at * width : (at + 1) * width], "little")


def predict_language(rows: DataFrame, model: Model, text: str = "text", drop_text: bool = True, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the language and the corrected share of n-grams that speak for it (0 to 1).

    ``und`` with score 0 where the text is null, has no letter, or the model knows no language. Equal shares: the first by name.
    Other columns pass through; new names that are taken get a trailing underscore. Repeated rows get the same answer each, an empty table gives
    an empty result, and very long texts are read whole.
    """
    taken = [c for c in rows.columns if not (drop_text and c == text)]
    pred, score = (fresh(n, taken) for n in names)
    languages, table, mistakes = model.languages, model.table, model.mistakes

    def maker():
        words = _Words(table, len(languages))
        low = (1 << LANE) - 1

        def one(found: list[bytes]):
            counts = sum(map(words.__getitem__, found))
            n = counts & low
            if not n or not languages:
                return "und", 0.0
            hits = [(counts >> (LANE * (i + 1))) & low for i in range(len(languages))]
            shares = [max(0.0, (h / n - e) / (1 - e)) if e < 1 else 0.0 for h, e in zip(hits, mistakes, strict=True)]
            best = max(range(len(languages)), key=lambda i: (shares[i], -i))
            return languages[best], min(1.0, shares[best])

        def run(texts):
            found = [pieces(t) for t in texts]
            words.learn(set().union(*found))
            made = [one(f) for f in found]
            return {pred: [a for a, _ in made], score: [b for _, b in made]}

        return run

    return per_text(rows, text, f"`{pred}` string, `{score}` double", maker, drop_text)
