import hashlib

import pytest
from pyspark.sql import functions as F

from jobharbor.functions import text as X


def run(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in rows.select("i", expression(F.col("t"))).orderBy("i").collect()]


MIXED = ["a\nb", "a\r\nb\rc\n", "x y\x85z", "\n", "", "a\n\n", "v\x0bf\x0cs\x1ce\x1d\x1e"]


def test_lines(spark):
    assert run(spark, MIXED, X.split_lines) == [t.splitlines() for t in MIXED]
    kept = run(spark, MIXED, X.split_lines_keep_ends)
    assert ["".join(k) for k in kept] == MIXED
    assert [[p for p in k if p] for k in kept] == [t.splitlines(keepends=True) for t in MIXED]


def test_strip_and_newlines(spark):
    texts = ["　 a b\x85\n", " \x1f ", "x"]
    assert run(spark, texts, X.strip) == [t.strip() for t in texts]
    assert run(spark, ["a\r\nb\rc\n"], X.universal_newlines) == ["a\nb\nc\n"]


def test_hash_and_id(spark):
    assert run(spark, ["é😀"], X.content_hash) == [hashlib.sha256("é😀".encode()).hexdigest()]
    ids = run(spark, ["a/b.md"], lambda t: X.chunk_id(t, F.lit(2)))
    assert ids == ["doc:" + hashlib.sha256(b"a/b.md||2").hexdigest()]


@pytest.mark.parametrize("length, chunks", [(1, 1), (2700, 1), (2701, 2), (3000, 2), (5401, 3)])
def test_chunk_counts(spark, length, chunks):
    assert len(run(spark, ["x" * length], lambda t: X.chunk_text(t, 3000, 300))[0]) == chunks


@pytest.mark.parametrize("size, overlap", [(7, 3), (7, 0), (1, 0), (10, 9), (5, 2)])
def test_chunks_are_the_windows_of_the_text(spark, size, overlap):
    texts = ["", "a", "accents éàü and 😀 emoji\nover lines", "abcdefg" * 5]
    step = size - overlap
    windows = [[t[s : s + size] for s in range(0, len(t), step)] for t in texts]
    assert run(spark, texts, lambda t: X.chunk_text(t, size, overlap)) == windows


@pytest.mark.parametrize("size, overlap", [(0, 0), (5, -1), (5, 5), (5, 6)])
def test_chunking_refused(size, overlap):
    with pytest.raises(ValueError):
        X.chunk_text(F, size, overlap)


ENTRY = "Foo.bar (mod.x attribute), 132\n"


@pytest.mark.parametrize(
    "text, kept",
    [
        ("intro\n" + ENTRY * 4, None),
        ("intro\n" + ENTRY * 5, "intro\n"),
        ("intro\r\n" + ENTRY * 5 + "prose after\n", "intro\r\n"),
        (ENTRY * 3 + "prose\n" + ENTRY * 2, None),
        (ENTRY * 2 + "gap\n" + ENTRY * 6, ENTRY * 2 + "gap\n"),
        ("a\n" + "__init__() (Some.Class method) , 45  \n" * 5, "a\n"),
        ("a\n" + "Été (mod classe), 4\n" * 5, None),
        ("a\n" + "Été (mod class), 4\n" * 5, "a\n"),
        ("a\n" + "(mod class), 4\n" * 5, None),
        ("", None),
    ],
)
def test_index_sections(spark, text, kept):
    assert run(spark, [text], X.strip_index) == [text if kept is None else kept]


@pytest.mark.parametrize(
    "path, suffix, kind",
    [
        ("a/b.md", "md", "md"),
        ("a/b.RST", "rst", "rst"),
        ("a.md/b", "", "unknown"),
        ("a/.md", "", "unknown"),
        ("a/b.tar.gz", "gz", "unknown"),
        ("a/b.", "", "unknown"),
        ("README", "", "unknown"),
    ],
)
def test_suffix(spark, path, suffix, kind):
    assert run(spark, [path], X.suffix) == [suffix]
    assert run(spark, [path], X.source_type) == [kind]


# Hand-worked conversions.
RST = [
    ("Docs\n====", "# Docs"),
    ("A\n=\nB\n-\nC\n~\nD\n^\nE\n\"\nF\n'\nG\n`", "# A\n## B\n### C\n#### D\n##### E\n###### F\n# G"),
    ("====\nDocs\n====\ntext", "====\n# Docs\ntext"),
    ("long title\n--", "long title\n--"),
    ("a\n\n---\nb", "a\n\n---\nb"),
    ("====\n====\n====", "# ====\n===="),
    ("  padded  \n========", "# padded"),
    (".. code-block:: py\n\n   x = 1\n\n   y\nend", "```py\nx = 1\n\ny\n```\nend"),
    (".. code-block:: py\n   x", "```py\nx\n```"),
    (".. code-block::\n\n\n\tx\n a\tb", "```\n\nx\n```\n a\tb"),
    (".. code-block:: c\n\n   Title\n   -----\nReal\n----", "```c\nTitle\n-----\n```\n## Real"),
    (".. code-block:: c", "```c\n```"),
    (".. code-block:: c\n.. code-block:: d\n   x", "```c\n```\n```d\nx\n```"),
    (".. note:: mind this\n.. WARNING::\n.. tip:: a ", "> **Note:** mind this\n> **Warning:** \n> **Tip:** a"),
    (" .. note:: not at the margin", " .. note:: not at the margin"),
    ("see `site <http://x>`_ and :ref:`here <there>`", "see [site](http://x) and [here](there)"),
    ("`plain` and `a <b>`", "`plain` and `a <b>`"),
    ("", ""),
]


def test_rst(spark):
    got = run(spark, [r for r, _ in RST], X.rst_to_markdown)
    for (rst, expected), markdown in zip(RST, got):
        assert markdown == expected, rst


def test_normalized_document(spark):
    rows = spark.createDataFrame([(" Docs\n====\n\n",)], "t string")
    make = lambda path: X.normalize_document(F.col("t"), F.lit("o/r"), F.lit(path), F.lit("abc"))
    rst, plain = rows.select(make("d/i.rst"), make("d/i.txt")).first()
    head = "---\nsource_repo: o/r\nsource_path: d/i.{0}\nsource_type: {1}\nsource_commit_sha: abc\n---\n\n"
    assert rst == head.format("rst", "rst") + "# Docs\n"
    assert plain == head.format("txt", "unknown") + "Docs\n====\n"


def test_text_functions_need_no_shuffle(spark):
    rows = spark.createDataFrame([("a", "t")], "p string, t string")
    made = rows.select(X.rst_to_markdown(F.col("t")), X.strip_index(F.col("t")), F.explode(X.chunk_text(F.col("t"), 9, 2)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
