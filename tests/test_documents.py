import datetime as dt
import hashlib
import re

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from jobharbor import schemas
from jobharbor.functions import vectors as V
from jobharbor.operators import gates, merge
from jobharbor.plans import catalogue, documents
from jobharbor.sources import landing
from jobharbor.sources.versions import VersionedTables
from jobharbor.streaming import ingest

ENTRY = "Foo.bar (mod.x attribute), 132\n"


def now():
    return F.lit("2026-01-10 00:00:00").cast("timestamp_ntz")



def lengths(make=lambda: lambda texts: [[len(t), 1.0] for t in texts]):
    return V.embed(make)


def write(folder, name, content):
    import os

    path = f"{folder}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content if isinstance(content, bytes) else content.encode())


def test_directory_cycle(spark, folder):
    docs, store = f"{folder}/docs", VersionedTables(spark, f"{folder}/store")
    write(docs, "a.txt", "x" * 3000)
    write(docs, "deep/er/b.md", "intro\n" + ENTRY * 5)
    write(docs, "empty.txt", "")
    write(docs, "index_only.txt", ENTRY * 5)
    write(docs, "bad.bin", b"caf\xc3\xa9 \xff\xfe!")
    write(docs, "paper.pdf", b"%PDF")
    tick = lambda run: ingest.tick_documents(spark, docs, store, lengths(), run, run, buckets=4)
    chunks = lambda: {
        (r["source_file"].rsplit("/", 1)[1], r["chunk_index"]): r.asDict()
        for r in store.read("chunks", schemas.CHUNKS).collect()
    }
    assert tick("r1") == {"processed": 3, "skipped": 0, "new": 3, "changed": 0}
    first = chunks()
    assert sorted(first) == [("a.txt", 0), ("a.txt", 1), ("b.md", 0), ("bad.bin", 0)]
    assert first["b.md", 0]["chunk"] == "intro\n" and first["bad.bin", 0]["chunk"] == "café !"
    assert first["a.txt", 1]["embedding"] == [300.0, 1.0]
    assert tick("r2") == {"processed": 0, "skipped": 3, "new": 0, "changed": 0}
    # an edit in place that shrinks a file removes its old tail; a change in the index is none
    write(docs, "a.txt", "y" * 10)
    write(docs, "deep/er/b.md", "intro\n" + ENTRY * 9)
    assert tick("r3") == {"processed": 1, "skipped": 2, "new": 0, "changed": 1}
    second = chunks()
    assert sorted(second) == [("a.txt", 0), ("b.md", 0), ("bad.bin", 0)]
    assert second["a.txt", 0]["id"] == first["a.txt", 0]["id"]  # ids survive content changes
    assert second["a.txt", 0]["processed_ts"] == "r3" and second["b.md", 0]["processed_ts"] == "r1"
    marks = {r["path"].rsplit("/", 1)[1]: r.asDict() for r in store.read("checkpoint", schemas.CHECKPOINT).collect()}
    assert marks["a.txt"]["chunk_ids"] == [second["a.txt", 0]["id"]] and marks["a.txt"]["chunks"] == 1
    assert sorted(marks) == ["a.txt", "b.md", "bad.bin"]


def test_unchanged_text_is_not_shuffled(spark, folder):
    """Below the join that finds the changes only paths and hashes move."""
    write(folder, "a.txt", "one")
    texts = landing.extract_text(landing.list_files(spark, folder))
    checkpoint = spark.createDataFrame([("x", "h", "t", 1, ["i"])], schemas.CHECKPOINT)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = gates.document_changes(texts, checkpoint)
        plan = changes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" in plan
    assert set(changes.columns) == {"path", "content_hash", "status", "previous_hash", "previous_chunks"}
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "hashpartitioning(path" in line


def test_vanished_files_keep_their_chunks(spark, folder):
    store = VersionedTables(spark, folder)
    pair = spark.createDataFrame([("a", "one"), ("b", "two")], "path string, text string")
    documents.run_cycle(store, pair, lengths(), "r1", "t1", buckets=1)
    documents.run_cycle(store, pair.where("path = 'a'").withColumn("text", F.lit("new")), lengths(), "r2", "t2", buckets=1)
    rows = {r["source_file"]: r["chunk"] for r in store.read("chunks", schemas.CHUNKS).collect()}
    assert rows == {"a": "new", "b": "two"}


def test_missing_model_fails_and_publishes_nothing(spark, folder):
    def broken():
        raise RuntimeError("no model")

    store = VersionedTables(spark, folder)
    one = spark.createDataFrame([("a", "one")], "path string, text string")
    with pytest.raises(Exception, match="no model"):
        documents.run_cycle(store, one, lengths(broken), "r1", "t1", buckets=1)
    assert store.version() == 0


def test_model_is_loaded_per_task_not_per_batch(spark):
    def make():
        seen = []

        def encode(texts):
            seen.append(len(texts))
            return [[float(len(seen))] for _ in texts]

        return encode

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = spark.range(20, numPartitions=1).select(V.embed(make)(F.col("id").cast("string"))[0].alias("n"))
        assert max(r["n"] for r in rows.collect()) == 4.0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_extractors(spark, folder):
    write(folder, "d/x.pdf", b"PDF")
    write(folder, "d/y.pdf", b"broken")
    write(folder, "d/z.txt", "a\r\nb")

    def parse(content):
        if content != b"PDF":
            raise ValueError
        return "parsed"

    texts = landing.extract_text(landing.list_files(spark, f"{folder}/d"), {"pdf": parse}).collect()
    assert {r["path"][-5:]: r["text"] for r in texts} == {"x.pdf": "parsed", "y.pdf": "", "z.txt": "a\nb"}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "id int, v array<float>")
    near = V.nearest(rows, "v", [1.0, 0.0], 3, "id").collect()
    assert [(r["id"], round(r["score"], 4)) for r in near] == [(1, 1.0), (2, 0.7071), (4, -1.0)]
    assert [r[0] for r in rows.orderBy("id").select(V.is_zero(F.col("v"))).collect()] == [False, False, True, False]
    assert rows.select(V.dummy_vector()).first()[0] == [0.0] * 8


# --- repositories -----------------------------------------------------------------------------

CONFIG = {"repo": "o/r", "include_patterns": ["docs/source/*.rst"], "within_hours": 10, "normalize_for_rag": True}


def commits(spark, sha, hours_old):
    at = dt.datetime(2026, 1, 10) - dt.timedelta(hours=hours_old)
    return spark.createDataFrame([("o/r", sha, at)], "repo string, commit_sha string, commit_ts timestamp_ntz")


def test_repository_sync(spark, folder):
    tree, store = f"{folder}/tree", VersionedTables(spark, f"{folder}/store")
    write(tree, "o/r/docs/source/index.rst", "Docs\n====\n")
    write(tree, "o/r/docs/source/deep/latin.rst", b"caf\xe9")
    write(tree, "o/r/README.md", "no match")
    write(tree, "o/r/.git/docs/source/x.rst", "no")
    config = gates.repo_config(spark, [CONFIG])

    def sync(run, sha, hours_old):
        at = commits(spark, sha, hours_old)
        files = landing.read_repo_files(spark, tree, at)
        return documents.sync_repos(store, files, at, config, run, now()).first()["decision"]

    assert sync("r1", "abc", 200) == "sync"  # age does not count on the first run
    docs = {r["source_path"]: r for r in store.read("repo_docs", schemas.REPO_DOCS).collect()}
    assert sorted(docs) == ["docs/source/deep/latin.rst", "docs/source/index.rst"]
    assert docs["docs/source/index.rst"]["normalized"].endswith("---\n\n# Docs\n")
    assert docs["docs/source/deep/latin.rst"]["normalized"] is None  # copied, but not UTF-8
    assert bytes(docs["docs/source/deep/latin.rst"]["content"]) == b"caf\xe9"
    state = store.read("repo_state", schemas.REPO_STATE).first()
    assert (state["last_commit_sha"], state["files_downloaded"]) == ("abc", 2)
    assert sync("r2", "def", 200) == "too_old"
    assert sync("r3", "abc", 1) == "unchanged"
    assert sync("r4", "abc", 11) == "too_old"  # age is judged first
    import os

    os.remove(f"{tree}/o/r/docs/source/deep/latin.rst")
    assert sync("r5", "def", 10) == "sync"  # exactly at the limit
    docs = {r["source_path"]: r["commit_sha"] for r in store.read("repo_docs", schemas.REPO_DOCS).collect()}
    assert docs == {"docs/source/index.rst": "def", "docs/source/deep/latin.rst": "abc"}  # no deletion
    texts = documents.documents_of(store.read("repo_docs", schemas.REPO_DOCS))
    assert {r["path"]: r["text"][:3] for r in texts.collect()}["o/r/docs/source/deep/latin.rst"] == "caf"


@pytest.mark.parametrize(
    "path, include, exclude, chosen",
    [
        ("docs/a/b.rst", ["docs/*.rst"], [], True),
        ("docs/a.md", ["docs/*.rst"], [], False),
        ("anything", [], [], True),
        ("anything", [], ["any*"], False),
        ("a.md", ["*.md"], ["a*"], False),
        ("b1", ["b[!a]"], [], True),
        ("ba", ["b[!a]"], [], False),
        ("A.MD", ["*.md"], [], False),
        ("a.b", ["a?b"], [], True),
        ("a[1]", ["a[[]1]"], [], True),
        ("x\ny", ["x*y"], [], True),
        ("xy2", ["x*y"], [], False),
    ],
)
def test_patterns(spark, path, include, exclude, chosen):
    row = spark.createDataFrame([(path,)], "p string")
    assert row.select(gates.matches_patterns(F.col("p"), include, exclude)).first()[0] is chosen


def test_repository_names(spark):
    names = ["o/r", "o/r/s", "o/", "/r", "plain"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    parts = [r[0] and tuple(r[0]) for r in rows.select(gates.repo_parts(F.col("n"))).collect()]
    assert parts == [("o", "r"), ("o", "r/s"), None, None, None]
    for name in names[2:]:
        with pytest.raises(ValueError):
            gates.parse_repo(name)
    assert gates.parse_repo("o/r/s") == ("o", "r/s")


def test_commit_time(spark):
    row = spark.createDataFrame([("2026-01-09T22:00:00Z", "2026-01-10T01:00:00+02:00", "bad")], "a string, b string, c string")
    hours = row.select(*[gates.age_hours(now(), gates.commit_time(F.col(c))) for c in "abc"]).first()
    assert tuple(hours) == (2.0, 1.0, None)


def test_lenient_decoding_equals_python(spark):
    import random

    r = random.Random(1)
    parts = [b"a", b"\n", "é".encode(), "日".encode(), "👍".encode(), b"\xff", b"\xc3", b"\x80", b"\xed\xa0\x80", b"\xf0\x9f", b"\xe2\x82", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"$1"]
    cells = [b"".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(400)] + [None, b""]
    rows = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(cells)], "k int, c binary")
    got = {x["k"]: x["t"] for x in rows.select("k", landing.decode_lenient(F.col("c")).alias("t")).collect()}
    assert got == {k: None if c is None else c.decode("utf-8", errors="ignore") for k, c in enumerate(cells)}


def test_second_pass_reads_only_what_is_new_or_edited(spark, folder, monkeypatch):
    import os
    import time

    from jobharbor.functions import vectors as V
    from jobharbor.sources import landing
    from jobharbor.streaming import ingest

    os.makedirs(f"{folder}/in")
    for n in range(6):
        with open(f"{folder}/in/f{n}.txt", "w") as file:
            file.write(f"text {n}" if n else "")
    with open(f"{folder}/in/paper.pdf", "wb") as file:
        file.write(b"%PDF")
    read, keep = [], landing.extract_text

    def noted(files, *more):
        read.append(sorted(os.path.basename(r["path"]) for r in files.select("path").collect()))
        return keep(files, *more)

    monkeypatch.setattr(landing, "extract_text", noted)
    store = VersionedTables(spark, f"{folder}/store")
    tick = lambda run: ingest.tick_documents(spark, f"{folder}/in", store, lambda chunk: V.dummy_vector(), run, run, buckets=2)
    assert tick("r1")["new"] == 5
    bad = lambda: sorted((os.path.basename(r["content"]), r["reason"]) for r in store.read("quarantine", schemas.QUARANTINE).collect())
    assert bad() == [("paper.pdf", "no text from pdf")]  # files without bytes are not listed at all
    time.sleep(0.05)
    with open(f"{folder}/in/f3.txt", "w") as file:
        file.write("another text")
    os.utime(f"{folder}/in/f4.txt")  # touched, not changed
    os.remove(f"{folder}/in/f5.txt")
    assert tick("r2") == {"processed": 1, "skipped": 3, "new": 0, "changed": 1}
    assert read[1] == ["f3.txt", "f4.txt"] and len(bad()) == 1
    assert tick("r3")["processed"] == 0 and len(read) == 2
    chunks = {os.path.basename(r["source_file"]): r["chunk"] for r in store.read("chunks", schemas.CHUNKS).collect()}
    assert chunks == {"f1.txt": "text 1", "f2.txt": "text 2", "f3.txt": "another text", "f4.txt": "text 4", "f5.txt": "text 5"}


def test_unchanged_texts_do_not_move_without_broadcast_joins(spark):
    """With broadcast joins off, what goes into an exchange has passed the filter of wanted paths, which has a fixed size."""
    rows = spark.createDataFrame([(f"p{n}", f"text {n}") for n in range(200)], "path string, text string")
    wanted = spark.createDataFrame([("p7", "h", "new"), ("p8", "h", "unchanged")], "path string, content_hash string, status string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = gates.to_process(wanted, rows)
        assert [tuple(r) for r in todo.collect()] == [("p7", "text 7", "h")]
        plan = todo._jdf.queryExecution().executedPlan().toString()
        exchanged = plan[plan.index("SortMergeJoin") :]
        assert exchanged.index("Exchange hashpartitioning(path") < exchanged.index("BroadcastHashJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_wanted_texts_and_kept_chunks_do_not_move(spark):
    """However many files are new, a text moves only if two filters of fixed size leave it open, and a live chunk only if one does."""
    texts = [(f"p{n}", f"text {n}") for n in range(300)]
    rows = spark.createDataFrame([*texts, (None, "no path"), ("empty", "")], "path string, text string").repartition(3)
    seen = spark.createDataFrame([(f"p{n}", f"text {n}", "h") for n in range(20)], "path string, text string, processed_ts string")
    checkpoint = merge.checkpoint_rows(seen.withColumn("content_hash", F.sha2("text", 256)), 100, 10, F.lit("t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = gates.document_changes(rows, checkpoint)
        changes = spark.createDataFrame(found.collect(), found.schema)
        todo = gates.to_process(changes, rows, own=True)
        live = merge.build_chunks(seen.withColumn("content_hash", F.sha2("text", 256)), 100, 10, F.lit("t")).cache()
        kept = merge.replace_chunks(live, spark.createDataFrame([("p3",), ("p9",), ("p250",)], "path string"), live.limit(0))
        expected = {(p, t, hashlib.sha256(t.encode()).hexdigest()) for p, t in texts[20:]}
        assert {tuple(r) for r in todo.collect()} == expected and todo.count() == len(expected)
        assert sorted(r["source_file"] for r in kept.collect()) == sorted(f"p{n}" for n in range(20) if n not in (3, 9))
        for frame in (todo, kept):
            plan = frame.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
            top = next(n for n, line in enumerate(plan) if "Union" in line)
            margin = plan[top].index("Union")
            sure = plan[top + 1 : next(n for n in range(top + 2, len(plan)) if plan[n][margin : margin + 1] in (":", "+") and plan[n][margin + 1] == "-")]
            # all that half of the rows meets is a filter; with broadcast joins off, any other join would move it
            assert set(re.findall(r"\w+Join\b", "".join(sure))) == {"BroadcastHashJoin"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_pass_lists_a_directory_once_with_few_tasks(spark, folder):
    """Every task reports to the driver: their number must not follow the number of folders or of small files."""
    for n in range(120):
        write(f"{folder}/in/d{n}", "a.txt", f"text {n}")
    started = lambda: max(spark.range(1, numPartitions=1).rdd.mapPartitions(lambda rows: [TaskContext.get().taskAttemptId()]).collect())
    before = started()
    files = landing.directory_files(spark, f"{folder}/in")
    listing = landing.list_metadata(files)
    assert listing.count() == 120 and listing.rdd.getNumPartitions() <= 8
    stale = listing.where("path like '%d7/%' or path like '%d8/%'")
    assert sorted(bytes(r["content"]) for r in landing.read_stale(files, stale).collect()) == [b"text 7", b"text 8"]
    assert started() - before < 120
    store, passes, load = VersionedTables(spark, f"{folder}/store"), [], landing.directory_files
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(landing, "directory_files", lambda *at: passes.append(at) or load(*at))
        done = ingest.tick_documents(spark, f"{folder}/in", store, lambda chunk: V.dummy_vector(), "r1", "r1", buckets=2)
    assert done["new"] == 120 and len(passes) == 1
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
