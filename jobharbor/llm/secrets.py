"""Secret scans: an Aho-Corasick keyword prefilter, anchored patterns near its hits, embedded checksums.

One automaton over all keywords runs once over each text, case aside for those that ignore it. A pattern is tried only where one
of its keywords was found, anchored at that place. Hex strings have no keyword: a text is probed at every 32nd character, which a run
of 32 cannot avoid, and the run around a probe that hits is measured. Kinds that carry a checksum count only if it holds.

Matches of one kind don't overlap and are leftmost, as a scan of the pattern alone would give them.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from jobharbor.llm.common import fresh, per_text, small_batches

#: What the kinds look like.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
HEX = frozenset("0123456789abcdef")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62_crc(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the part after the prefix, in base 62."""
    body, check = match[1][:-6], match[1][-6:]
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def _luhn(match: re.Match) -> bool:
    digits = [int(c) for c in match[0] if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def _signed_token(match: re.Match) -> bool:
    """The first part is a JSON object that names an algorithm."""
    part = match[0].split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


def _private_key(match: re.Match) -> bool:
    """The body is base64 of a DER sequence as long as it says."""
    try:
        raw = base64.b64decode("".join(match[2].split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(raw) < 4 or raw[0] != 0x30:
        return raw.startswith(b"openssh-key-v1\0")
    if raw[1] < 0x80:
        return raw[1] + 2 == len(raw)
    n = raw[1] & 0x7F
    return int.from_bytes(raw[2 : 2 + n], "big") + 2 + n == len(raw)


@dataclass(frozen=True)
class Kind:
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    #: what a match must hold beyond the pattern
    holds: Callable[[re.Match], bool]
    any_case: bool = False
    #: characters whose run decides: where one start in it fails, all do
    run: re.Pattern | None = None


KINDS = (
    Kind("assign", ASSIGN_WORDS, re.compile(ASSIGN, re.I | re.A), lambda m: len(m[2]) >= LEAST_ASSIGN, any_case=True),
    Kind("access", ("AKIA",), re.compile(ACCESS), lambda m: len(m[0]) >= LEAST_ACCESS),
    Kind("hex", (), re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= LEAST_HEX),
    Kind("host_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), _base62_crc),
    Kind("package_token", ("npm_",), re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), _base62_crc),
    Kind("signed_token", ("eyJ",), re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), _signed_token, run=re.compile("[A-Za-z0-9_-]+")),
    Kind(
        "private_key",
        ("-----BEGIN ",),
        re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----"),
        _private_key,
    ),
    Kind("card", ("card", "visa", "mastercard"), re.compile(r"(?:mastercard|card|visa)[^0-9\n]{0,20}(\d(?:[ -]?\d){12,18})(?!\d)", re.I | re.A), _luhn, any_case=True),
)
BASE = ("assign", "access", "hex")


def ascii_lower(text: str) -> str:
    """Lower case of A to Z alone: places stay what they are."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    """Over lower-cased text; the entries of a keyword are (kind, length, keyword in its own case or None)."""
    entries: dict[str, list] = {}
    for number, kind in enumerate(KINDS):
        for word in kind.keywords:
            entries.setdefault(word.lower(), []).append((number, len(word), None if kind.any_case else word))
    found = ahocorasick.Automaton()
    for word, values in entries.items():
        found.add_word(word, tuple(values))
    found.make_automaton()
    return found


def _hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of at least 32 hex characters, found from probes 32 apart."""
    runs, end = [], 0
    for probe in [i for i, c in enumerate(text[LEAST_HEX - 1 :: LEAST_HEX]) if c in HEX]:
        at = probe * LEAST_HEX + LEAST_HEX - 1
        if at < end:
            continue
        first, end = at, at + 1
        while first and text[first - 1] in HEX:
            first -= 1
        while end < len(text) and text[end] in HEX:
            end += 1
        if end - first >= LEAST_HEX:
            runs.append((first, end))
    return runs


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS; places count characters."""
    starts: dict[int, list[int]] = {}
    for last, values in _automaton().iter(ascii_lower(text)):
        for number, length, exact in values:
            at = last - length + 1
            if exact is None or text.startswith(exact, at):
                starts.setdefault(number, []).append(at)
    found = [(first, 2, end) for first, end in _hex_runs(text)]
    for number, places in starts.items():
        kind, end = KINDS[number], -1
        for at in sorted(set(places)):
            if at < end:
                continue
            if match := kind.pattern.match(text, at):
                end = match.end()
                if kind.holds(match):
                    found.append((at, number, end))
            elif kind.run:
                end = kind.run.match(text, at).end()
    return [(KINDS[number].name, first, end) for first, number, end in sorted(found)]


def scan_secrets(rows: DataFrame, text: str = "text", into: str = "secrets", drop_text: bool = False) -> DataFrame:
    """Add array<struct<kind, start, end>>; null and empty texts have none. Other columns pass through.

    A column named ``into`` is kept, the new one then gets a trailing underscore. Repeated rows are scanned each; an empty table gives an empty
    result. The work is in proportion to the text, however long and whatever it repeats.
    """
    name = fresh(into, [c for c in rows.columns if not (drop_text and c == text)])

    def maker():
        def spans(one: str):
            return [{"kind": kind, "start": first, "end": end} for kind, first, end in find_secrets(one)]

        return lambda texts: {name: [spans(t) for t in texts]}

    return per_text(rows, text, f"`{name}` array<struct<kind: string, start: bigint, end: bigint>>", maker, drop_text)


def redact(rows: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same columns, with every span of a secret replaced; overlapping spans become one mark. Null stays null."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            made = pa.array((None if v.as_py() is None else _redacted(v.as_py(), mark) for v in batch.column(text)), type=pa.string())
            yield pa.RecordBatch.from_arrays([made if c == text else batch.column(c) for c in names], names=names)

    return small_batches(rows).mapInArrow(run, rows.schema)


def _redacted(text: str, mark: str) -> str:
    parts, at = [], 0
    for _, start, end in find_secrets(text):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])
