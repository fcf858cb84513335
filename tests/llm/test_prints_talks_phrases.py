"""SimHash groups, repaired conversations and collocations against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import xxhash

from jobharbor.llm import conversations, phrases, simhash
from tests.llm.frames import awkward_texts, documents, prose, with_clashes

# --- simhash ----------------------------------------------------------------------------------


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    made = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=4):
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            root[find(j)] = find(i)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(i)] = min(least.get(find(i), id_), id_)
    return Counter((id_, f"{prints[i]:016x}", least.get(find(i))) for i, (id_, _) in enumerate(rows))


def edited(seed, words, edits):
    r, base = random.Random(seed), prose(7, words).split(" ")
    for _ in range(edits):
        base[r.randrange(len(base))] = "w" + str(r.randrange(5))
    return " ".join(base)


SIMHASH = {
    "awkward": [*enumerate(awkward_texts())],
    "near copies": [(i, edited(i, 300, i % 4)) for i in range(120)],
    "null and repeated ids": [(None, None), (None, ""), (3, "a b"), (3, "A\tb"), (None, "only here"), (2, "a b c d e")],
    "empty": [],
}


@pytest.mark.parametrize("name", SIMHASH)
@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_simhash(spark, name, block):
    rows = SIMHASH[name]
    frame = with_clashes(documents(spark, [t for _, t in rows], [i for i, _ in rows]), "fingerprint", "component_id", "root", "n", "mask")
    got = Counter(map(tuple, simhash.simhash_groups(frame, block=block, levels=1).collect()))
    assert got == plain_groups(rows)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_links_of_runs(radius):
    r = np.random.default_rng(radius)
    centres = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = centres[r.integers(0, 20, 300)]
    for _ in range(3):
        prints = prints ^ (np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64))
    cuts = np.sort(r.integers(0, 300, 6))
    ends = np.array([next((int(c) for c in cuts if c > i), 300) for i in range(300)])
    got = {(int(i), int(j)) for a, b in simhash.links(prints, ends, radius) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, ends[i]) if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}


def test_finer_masks_part_all_bits():
    for mask in simhash.finer(0) + simhash.finer(simhash.finer(0)[2]):
        parts = [m ^ mask for m in simhash.finer(mask)]
        assert len(parts) == 5 and sum(parts) == (1 << 64) - 1 - mask
        assert all(a & b == 0 for a, b in itertools.combinations(parts, 2))


def test_print_of_a_long_text_in_blocks(monkeypatch):
    text = prose(3, 4000)
    monkeypatch.setattr("jobharbor.llm.common.word_blocks.__defaults__", (100,))
    assert simhash.simhash(text) % (1 << 64) == plain_print(text)


# --- conversations ----------------------------------------------------------------------------

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        mine = out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def accepted(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def plain_repair(rows):
    """Cheapest audit by search over (row, what has been read), the repaired lines with it."""
    seen, faults = set(), []
    for _, role, text in rows:
        if not text.strip(WHITE):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if text.rstrip(WHITE)[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)

    @cache
    def best(i, last, inserted):
        """(cost, audit, lines) from row i on; ``last``: initial read last, '' at the start, 's' only first."""
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in {"": "u", "s": "u", "u": "a", "a": "u"}[last]:
                    c, a, lines = best(i, role[0], inserted + 1)
                    ways.append((c + 5, "I" + a, (f"{role}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, lines = best(i + 1, last, 0)
            ways.append((c + 2, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                for new, cost, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if new[:1] and new[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[last]:
                        c, a, lines = best(i + 1, new[:1], 0)
                        ways.append((c + cost + extra, letter + a, (f"{new}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    assert accepted("".join(line[0] for line in lines))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def in_order(rows):
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))


def talk(seed, convs=60, turns=9):
    r, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Is it?", "cut off", " \t", "", None, "Fine. ", "Fine.\n", "odd. ", "more words here."]
    for conv in range(convs):
        for turn in range(r.randrange(1, turns)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            rows.append((conv if conv else None, r.choice([turn, turn, turn, turn * 2, None]), role, r.choice(texts)))
    return rows + rows[:7]


TALKS = {"awkward": talk(1), "more": talk(2, 200, 7), "one long": [(1, t, ["user", "assistant"][t % 2], f"Line {t % 40}.") for t in range(150)], "empty": []}


@pytest.mark.parametrize("name", TALKS)
def test_conversations(spark, name):
    rows = TALKS[name]
    frame = with_clashes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), "conv", "copies", "sign", "audit")
    got = {r[0]: tuple(r[1:]) for r in conversations.repair_conversations(conversations.damage(frame)).collect()}
    assert got == {conv: plain_repair(in_order(left)) for conv, left in plain_damage(rows).items()}


def test_nodes_from_the_end():
    nodes = [conversations.END]
    for sign in reversed("suaUad"):
        nodes.append(conversations.before(sign, nodes[-1]))
    assert conversations.audit(nodes) == "KKDDKD" and nodes[-1][conversations.START][0] == 6


# --- collocations -----------------------------------------------------------------------------


def plain_phrases(rows, support, longest=5):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= support}
        scored = []
        for p, a in found.items():
            if len(p) == 1:
                continue
            inside = any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        scored.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(scored)]
    return out


def speech(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "times", "é", "İ", "a-b", "x y", "日本", "(so", "it)"]
    ends = [" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "!? ", "\x0b"]
    line = lambda: "".join(r.choice(words) + r.choice(ends) for _ in range(r.randrange(0, 60))) + r.choice(["", "New York Times of the day it said"])
    return [(r.choice(["en", "fr", None]), line()) for _ in range(n)]


PHRASES = {
    "speech": (speech(1, 150), 6),
    "awkward": ([("en", t) for t in awkward_texts()] + [(None, None), ("de", ""), ("de", "a b c d e f g")], 2),
    "hot": ([("en", "same words again and again")] * 400 + speech(3, 20), 20),
    "empty": ([], 2),
}


@pytest.mark.parametrize("name", PHRASES)
@pytest.mark.parametrize("size", [phrases.RUN, 50])
def test_collocations(spark, name, size):
    rows, support = PHRASES[name]
    frame = with_clashes(spark.createDataFrame(rows, "lang string, text string"), "doc_id", "shard", "phrase", "n", "total").repartition(5)
    got = phrases.collocations(frame, support=support, top=10**6, shards=3, size=size).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(rows, support))
    if name == "speech":
        few = phrases.collocations(frame, support=support, top=4, shards=3, size=size).collect()
        assert sorted(map(tuple, few)) == sorted(x for x in plain_phrases(rows, support) if x[1] <= 4)


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 9 * 10**15, 10**16 - 3, 9 * 10**15 + 7, 9 * 10**15 + 11
    wide = lambda *names: " * ".join(f"cast({x} AS decimal(17,0))" for x in names)
    row = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    got = row.select(F.expr(f"(cast(1000 AS decimal(4,0)) * {wide('a', 'n')}) div ({wide('l', 'r')})")).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 64)
    text = prose(4, 2000) + ", " + prose(5, 50)
    whole = b" ".join(w for part in phrases.tokens(text) for w in part)
    monkeypatch.undo()
    assert whole == b" ".join(w for part in phrases.tokens(text) for w in part)


def test_runs_of_words_are_packed():
    """What every length reads again is written once: as plain hashes it took 4 bytes a word, which Parquet can't compress."""
    rng = np.random.default_rng(7)
    words = rng.integers(1, 1 << 32, 5000, dtype=np.uint32)
    run = words[np.minimum(rng.zipf(1.3, 100_000) - 1, 4999)]
    for hashes in (run, run[:1], run[:0], words, np.zeros(3, dtype=np.uint32)):
        assert np.array_equal(phrases._unpacked(phrases._packed(hashes)), hashes)
    assert len(phrases._packed(run)) < 4 * len(run) / 2
