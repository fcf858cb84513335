import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobharbor.llm import neighbours, ngram_join, packing, repeats
from tests.llm.frames import DOCUMENTS, awkward_texts, documents, prose, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


# --- n-gram join ---


def linked(rows):
    """class and number of links by brute force; rows that share an id count as one class."""
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    smallest = {}
    for i in range(n):
        if rows[i][0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), rows[i][0]), rows[i][0])
    return Counter((rows[i][0], smallest.get(find(i)), links[i]) for i in range(n))


def chain():
    """Texts of which each is like the next, but the ends are not alike, and a large group of near copies, and a line in all."""
    r = random.Random(3)
    texts, words = [], prose(1, 80).split()
    for k in range(20):
        words = words[:]
        words[(7 * k) % 80] = f"new{k}"
        texts.append(" ".join(words))
    body = prose(2, 120).split()
    for k in range(60):
        own = body[:]
        own[r.randrange(120)] = f"own{k}"
        texts.append(" ".join(own))
    return texts + ["a very common line of words here " + prose(100 + k, 30) for k in range(40)]


JOINS = {
    "awkward": list(enumerate(awkward_texts())),
    "chain": list(enumerate(chain())),
    "hot copies": [(i, chain()[0]) for i in range(200)] + [(500 + i, t) for i, t in enumerate(chain())],
    "null ids": [(None, chain()[0]), (None, chain()[0]), (1, chain()[0]), (2, chain()[1])],
    "empty": [],
}


@pytest.mark.parametrize("name", JOINS)
@pytest.mark.parametrize("members", [1024, 7])
def test_links_and_classes(spark, name, members):
    rows = JOINS[name]
    frame = with_clashes(documents(spark, [t for _, t in rows], [i for i, _ in rows]), "key", "bands", "node")
    got = ngram_join.ngram_jaccard_join(frame, members=members)
    assert got.columns == ["doc_id", "class_id", "n_links"]
    assert Counter(map(tuple, got.collect())) == linked(rows)


def test_one_of_each_class_stays(spark):
    rows = JOINS["awkward"] + [(None, chain()[0])]
    frame = with_clashes(documents(spark, [t for _, t in rows], [i for i, _ in rows]), "_gone", "_may")
    left = ngram_join.keep_one(frame)
    assert left.schema == frame.schema
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted({c for _, c, _ in linked(rows) if c is not None})
    assert left.where("doc_id is null").count() == 1


def repeating():
    """Rows that share an id: alike, near copies and unrelated; a class whose smallest id is also that of another text."""
    a, b = chain()[:2]
    other = prose(4321, 70)
    return [(3, a), (5, b), (5, b), (5, other), (7, other + " end"), (8, a), (9, prose(77, 50)), (9, prose(77, 50)), (9, None), (9, None), (3, prose(78, 50)), (None, a)]


@pytest.mark.parametrize("members", [1024, 2])
def test_rows_that_share_an_id(spark, members):
    rows = repeating()
    got = ngram_join.ngram_jaccard_join(documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3), members=members)
    assert Counter(map(tuple, got.collect())) == linked(rows)


def test_nothing_unrelated_goes_with_a_shared_id(spark):
    rows = repeating()
    frame = with_clashes(documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3), "_pick", "mark")
    left = ngram_join.keep_one(frame)
    assert left.schema == frame.schema
    want = Counter(rows[k] for k in (0, 3, 6, 8, 9, 10, 11))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == want


def test_bands_reach_the_recall():
    for similarity, recall in [(0.8, 0.999), (0.5, 0.9), (0.9, 0.99)]:
        bands, rows = ngram_join.choose_bands(similarity, recall)
        assert bands * rows <= ngram_join.HASHES and 1 - (1 - similarity**rows) ** bands >= recall


# --- repeats ---


def removed(rows, length):
    """By brute force; rows in the order of id (null last) and then of the hash the operator orders repeated ids by."""
    seen, out = set(), []
    for place, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone])
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages():
    r = random.Random(8)
    shared = [prose(50 + k, 30) for k in range(6)]
    texts = []
    for k in range(80):
        parts = [prose(300 + k, r.randrange(40))]
        for _ in range(r.randrange(4)):
            parts += [r.choice(shared)[r.randrange(20) :], prose(r.randrange(10**6), r.randrange(20))]
        texts.append("é".join(parts))
    return texts


REPEATS = {
    "awkward": list(enumerate(awkward_texts())),
    "passages": list(enumerate(passages())),
    "hot copies": [(i, passages()[3]) for i in range(100)] + [(100 + i, t) for i, t in enumerate(passages())],
    "null id": [*enumerate(passages()[:5]), (None, passages()[2])],
    "rows alike": [(1, passages()[3]), (1, passages()[3]), (1, passages()[3]), (2, "x"), (2, "x")],
    "periodic": [(0, "ab" * 300), (1, "b" + "ab" * 200), (2, "a" * 99), (3, "a" * 100), (4, "a" * 101)],
    "empty": [],
}


@pytest.mark.parametrize("name", REPEATS)
def test_repeated_passages(spark, name, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 5000)
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    rows = REPEATS[name]
    frame = with_clashes(documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3), "sub", "spans", "n_bytes")
    got = repeats.remove_repeats(frame)
    assert Counter(tuple(r)[:5] for r in got.collect()) == removed(rows, 100)


def test_equal_ids_with_different_texts_are_told_apart(spark):
    body = prose(12345, 60)
    a, b = body + " end", "start " + body
    got = {r["kept_sha256"]: r for r in repeats.remove_repeats(documents(spark, [a, b], [5, 5])).collect()}
    sizes = sorted(r["n_removed"] for r in got.values())
    assert sizes[0] == 0 and sizes[1] >= len(body.encode())


def surrounded(n):
    """A passage with other text around it in each row; some rows come again, as they are."""
    passage = prose(777, 40)
    rows = [(k, f"{prose(10_000 + k, 12)} {passage} {prose(50_000 + k, 12)}") for k in range(n)]
    return rows + [(n + k, rows[k][1] + " end") for k in range(0, n, 9)]


def test_one_passage_in_many_surroundings(spark, monkeypatch):
    limit, whole = 3000, repeats.later_windows

    def bounded(data, starts, length):
        assert len(data) <= 3 * limit, "a block without bound"
        return whole(data, starts, length)

    monkeypatch.setattr(repeats, "BLOCK", limit)
    monkeypatch.setattr(repeats, "later_windows", bounded)
    rows = surrounded(2000)
    frame = documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    assert Counter(tuple(r)[:5] for r in repeats.remove_repeats(frame).collect()) == removed(rows, 100)


def test_rows_that_come_again_among_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    rows = surrounded(300)
    again = rows[100:200]
    frame = documents(spark, [t for _, t in rows + again], [i for i, _ in rows + again]).repartition(5)
    got = Counter(tuple(r)[:5] for r in repeats.remove_repeats(frame).collect())
    gone = Counter((i, len(t.encode()), len(t.encode()), 1, hashlib.sha256(b"").hexdigest()) for i, t in again)
    # which of the hundred is first of its kind is told by the id, so the others are as without them
    assert got - gone == removed(rows, 100) and not gone - got


def test_few_rows_of_an_anchor_meet(spark):
    rows = surrounded(3000)
    frame = documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(2)
    found = repeats._stretches(repeats.keyed(frame, "doc_id", "text")[0], 100, 24)
    assert found.groupBy(found.columns[0]).count().agg({"count": "max"}).first()[0] <= 100


def test_later_windows_are_those_with_a_long_previous_factor():
    r = random.Random(5)
    for length in (16, 20, 100):
        data = np.frombuffer("".join(r.choice("ab") for _ in range(3000)).encode(), dtype=np.uint8)
        starts = np.arange(len(data) - length + 1)
        seen, want = set(), []
        for p in starts:
            want.append(data[p : p + length].tobytes() in seen)
            seen.add(data[p : p + length].tobytes())
        assert repeats.later_windows(data, starts, length).tolist() == want


# --- neighbours ---


def nearest(rows, queries, k=10):
    out = {}
    for q, v in queries:
        found = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q)
        out[q] = found[:k]
    return out


def vectors(n, hot=0):
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + 0.3 * r.normal(size=24)]) for i in range(n)]
    return [(i, rows[0][1]) if i < hot else (i, v) for i, v in rows]


VECTORS = "vec_id bigint, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 200)
    rows = vectors(3000, hot=900)
    frame = with_clashes(table(spark, rows), "query", "point", "rank")
    queries = [r for r in rows if r[0] % 50 == 0]
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(frame, frame.where("vec_id % 50 = 0")).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = nearest(rows, queries)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    dist = dict(rows)
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        assert all(s == pytest.approx(float(np.linalg.norm(np.array(dist[q]) - np.array(dist[i]))), abs=1e-12) for s, i in found)
        if q < 900:
            assert found == want[q]  # ties of copies go to the smaller ids


def test_few_rows_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0]), (None, [1.0, 1.0]),
            (8, [1.0, 0.0]), (8, [1.0, 0.0]), (100, [3.0, 4.0])]
    frame = table(spark, rows)
    got = neighbours.nearest(frame, frame.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 8), (0, 2, 1), (0, 3, 100), (100, 1, 1), (100, 2, 0), (100, 3, 8)]
    assert neighbours.nearest(table(spark, []), table(spark, [])).count() == 0
    assert neighbours.nearest(table(spark, [(0, None)]), table(spark, [(0, None)])).count() == 0


def test_chi_square_quantile():
    draws = (np.random.default_rng(0).standard_normal((200_000, 8)) ** 2).sum(axis=1)
    assert (draws <= neighbours.chi_square_quantile(0.99, 8)).mean() == pytest.approx(0.99, abs=0.002)


# --- packing ---


@pytest.mark.parametrize("lengths", [[10] * 500, [2048] * 20 + [1] * 50, list(range(1, 2049)), [1025] * 30 + [1023] * 40, [], [700, 700, 700, 600, 600, 600, 1348]])
def test_sequences_are_full_and_without_gaps(spark, lengths):
    rows = [(i, 0, n, "mine", "mine") for i, n in enumerate(lengths)]
    frame = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint, sequence_id string, _place string").repartition(5)
    got = packing.pack(frame).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(lengths)))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id_"] if lengths else 0].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    # first-fit decreasing, done one by one, needs no fewer
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r, k) for k, r in enumerate([*rooms, packing.CAPACITY]) if r >= n)[1]
        rooms = [*rooms, packing.CAPACITY] if fit == len(rooms) else rooms
        rooms[fit] -= n
    assert len(by) <= len(rooms)


@pytest.mark.parametrize("bad", [0, None, 2049])
def test_lengths_out_of_range(spark, bad):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0, 0, bad)], "doc_id bigint, piece int, length bigint"))


def test_pieces_of_awkward_rows(spark):
    library = Tokenizer.from_file(PATH)
    texts = awkward_texts()
    rows = [*enumerate(texts), (3, texts[3]), (None, "null id")]
    frame = with_clashes(documents(spark, [t for _, t in rows], [i for i, _ in rows]), "pieces", "piece", "offset")
    got = Counter(tuple(r)[:5] for r in packing.best_fit_packing(frame, PATH).collect())
    want = Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert got == want
    assert packing.best_fit_packing(spark.createDataFrame([], DOCUMENTS), PATH).count() == 0
