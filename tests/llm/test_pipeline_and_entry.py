import hashlib
import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from jobharbor.llm import secrets
from jobharbor.llm.common import stored
from tests.compare import connect, difference
from tests.llm.frames import documents, prose, with_clashes

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, made = spark.read.parquet(f"{SF}/documents.parquet"), {}
    made["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = made[name] = stored(stage(spark, docs, SF), f"test-{name}")
    return made


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages_hand_on_the_columns_of_documents(stages):
    assert all(stages[name].columns == COLUMNS for name, _ in corpus_pipeline.STAGES[:-1])


def test_toxicity_keeps_clean_documents(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(texts(stages["documents"])) - set(texts(stages["toxicity"]))
    assert not any(labels.get(i) == 0 for i in gone)
    assert all(t == texts(stages["documents"])[i] for i, t in texts(stages["toxicity"]).items())


def test_one_of_equal_texts_stays(stages):
    before, after = texts(stages["toxicity"]), texts(stages["exact_dedup"])
    largest = {}
    for i, t in before.items():
        largest[t or ""] = max(i, largest.get(t or "", i))
    assert after == {i: before[i] for i in largest.values()}


def test_one_of_each_near_duplicate_class_stays(stages):
    before, after = texts(stages["exact_dedup"]), texts(stages["ngram_join"])
    sets, root = {i: shingles(t) for i, t in before.items()}, {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in before:
        for j in before:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert after == {i: before[i] for i in before if find(i) == i}


def test_secrets_are_hidden_and_nothing_else(stages):
    before, after = texts(stages["ngram_join"]), texts(stages["secrets"])
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert (after[i] == t) == (not secrets.find_secrets(t or "")) and not secrets.find_secrets(after[i] or "")
    assert stages["secrets"].where("n_chars <> length(text)").count() == 0


def test_every_kept_text_is_packed(stages):
    packed = stages["packing"]
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(texts(stages["secrets"]))
    rooms = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert rooms.where("n <> end or n > 2048").count() == 0


def test_stages_on_awkward_and_empty_documents(spark):
    rows = [(0, None, None, None, None), (1, "", "en", None, 0), (None, "same text", "en", "s", 9), (2, "same text", None, "s", 9), (2, "same text", None, "s", 9)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), f"test-{name}")
    assert docs.count() == 0


def test_queries_are_registered_once_each():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_sql_of_exact_dedup(spark):
    database = connect(SF)
    assert isinstance(database, duckdb.DuckDBPyConnection)
    assert difference(spark, SF, database, __spark_entry__.queries()["op8_exact_dedup"], __spark_entry__.oracle_sql()["op8_exact_dedup"]) is None


def test_query_columns(spark):
    """Digests of the queries against plain recomputation on whole small tables."""
    docs = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    queries = __spark_entry__.queries()
    got = queries["op6_secrets"](spark, SF).collect()
    for r in got:
        spans = secrets.find_secrets(docs[r["doc_id"]] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in secrets.BASE)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    flags = Counter((r["held_out"], r["predicted"] == int(r["score"] >= 0.7)) for r in queries["op1_toxicity"](spark, SF).collect())
    assert set(flags) <= {(True, True), (False, True)} and sum(flags.values()) == len(docs)
    assert queries["op10_language"](spark, SF).count() == len(docs)
    assert queries["op9_sharding"](spark, SF).where("shard_bytes > 1048576").count() == 0


def test_stages_with_columns_named_like_their_own(spark):
    names = ("_bits", "_bucket", "_may", "_row", "_gone", "_own", "_sha", "_key")
    docs = with_clashes(documents(spark, [prose(k, 50) for k in (1, 1, 2, 3)] + ["token=abcdefgh12345"]), *names)
    from jobharbor.llm import exact, ngram_join, secrets

    for stage in (lambda d: exact.keep_first(d, keep="max"), ngram_join.keep_one, secrets.redact):
        left = stage(docs)
        assert left.columns == docs.columns
        assert sorted(r["doc_id"] for r in left.collect()) in ([0, 2, 3, 4], [1, 2, 3, 4], [0, 1, 2, 3, 4])
