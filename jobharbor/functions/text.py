"""Text functions as column expressions: no shuffle, no Python worker.

A document is one cell, so everything that looks along its lines (runs, look-ahead, blocks) is
done inside the row with array functions. Nothing is exploded and nothing is grouped, so a corpus
of any size streams through in one narrow stage and a large source never becomes a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space and as line boundaries.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_BREAK = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
AFTER_LINE_BREAK = r"(?<=[\n\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])|(?<=\r)(?!\n)"

# An index entry such as "name (pkg.mod attribute), 132" on a line of its own.
INDEX_KINDS = "attribute|method|class|function|module|exception"
INDEX_LINE = (
    rf"^[{WS}]*[\p{{L}}\p{{N}}_.(){WS}]+\([\p{{L}}\p{{N}}_.{WS}]+(?:{INDEX_KINDS})\)"
    rf"[{WS}]*,[{WS}]*\p{{Nd}}+[{WS}]*$"
)
# Every index line contains this, so a text without it needs no line split.
INDEX_HINT = rf"\)[{WS}]*,[{WS}]*\p{{Nd}}"

# Heading underline characters and the Markdown level of each; others give level 1.
UNDERLINE_LEVELS = {"=": 1, "-": 2, "~": 3, "^": 4, '"': 5, "'": 6}
UNDERLINE_CHARS = "=-~^\"'`#*+<>"
UNDERLINE_LINE = r"""^[=\-~^"'`#*+<>]+$"""
ADMONITIONS = "note|warning|tip|important"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind, in linear time."""
    return F.btrim(text, F.lit(WHITESPACE))


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines without their ends; an ending line break does not open another line."""
    parts = F.split(text, LINE_BREAK, -1)
    return let(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def split_lines_keep_ends(text: Column) -> Column:
    return F.split(text, AFTER_LINE_BREAK, -1)


# --- hashes, ids, chunks ---------------------------------------------------------------------


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(path: Column, index: Column) -> Column:
    """Stable id of a chunk. The hash part of the key is empty, so ids survive content changes."""
    return F.concat(F.lit("doc:"), F.sha2(F.concat_ws("|", path, F.lit(""), index), 256))


def check_chunking(size: int, overlap: int) -> int:
    if size <= 0:
        raise ValueError("chunk size must be > 0")
    if overlap < 0:
        raise ValueError("overlap must be >= 0")
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    return size - overlap


def chunk_text(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Overlapping chunks as an array; a chunk starts every ``size - overlap`` characters.

    The text is cut once into steps and each chunk is a step plus the head of the following
    ones, so the cost stays linear in the text however long it is.
    """
    step = check_chunking(size, overlap)
    reach = -(-size // step)
    steps = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    if reach == 1:
        return steps
    return let(
        steps,
        lambda s: F.transform(
            s, lambda _, i: F.substring(F.array_join(F.slice(s, i + 1, reach), ""), 1, size)
        ),
    )


# --- index sections --------------------------------------------------------------------------


def strip_index(text: Column, threshold: int = 5) -> Column:
    """Cut a text before its first run of at least ``threshold`` index lines."""

    def cut(lines: Column) -> Column:
        flags = F.array_join(
            F.transform(
                lines,
                lambda line: F.when(line.contains("(") & line.rlike(INDEX_LINE), "1").otherwise("0"),
            ),
            "",
        )
        return let(
            F.instr(flags, "1" * threshold),
            lambda at: F.when(at > 0, F.array_join(F.slice(lines, 1, at - 1), "")).otherwise(text),
        )

    return F.when(text.rlike(INDEX_HINT), let(split_lines_keep_ends(text), cut)).otherwise(text)


# --- Markdown normalisation ------------------------------------------------------------------


def suffix(path: Column) -> Column:
    """Lower-case extension of the last path segment; a leading dot alone is not one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1))


def source_type(path: Column) -> Column:
    ext = suffix(path)
    return F.when(ext.isin("md", "rst"), ext).otherwise("unknown")


def frontmatter(repo: Column, path: Column, commit: Column) -> Column:
    return F.concat(
        F.lit("---\nsource_repo: "), repo,
        F.lit("\nsource_path: "), path,
        F.lit("\nsource_type: "), source_type(path),
        F.lit("\nsource_commit_sha: "), commit,
        F.lit("\n---\n\n"),
    )


def normalize_document(text: Column, repo: Column, path: Column, commit: Column) -> Column:
    body = strip(text)
    converted = F.when(source_type(path) == "rst", rst_to_markdown(body)).otherwise(body)
    return F.concat(frontmatter(repo, path, commit), converted, F.lit("\n"))


def _line_class(line: Column, following: Column) -> Column:
    """One letter per line, from the line and its successor alone.

    b blank; A-F heading text of level 1-6; P-U the same, indented; c code directive;
    i indented; n anything else.
    """
    title = strip(line)
    indented = line.startswith("   ") | line.startswith("\t")
    heading = following.rlike(UNDERLINE_LINE) & (F.length(following) >= F.length(title))
    first = F.substring(following, 1, 1)
    levels = [UNDERLINE_LEVELS.get(c, 1) - 1 for c in UNDERLINE_CHARS]
    return (
        F.when(title == "", "b")
        .when(
            heading,
            F.when(indented, F.translate(first, UNDERLINE_CHARS, "".join("PQRSTU"[n] for n in levels)))
            .otherwise(F.translate(first, UNDERLINE_CHARS, "".join("ABCDEF"[n] for n in levels))),
        )
        .when(line.startswith("..") & line.rlike(rf"^\.\.[{WS}]+code-block::"), "c")
        .when(indented, "i")
        .otherwise("n")
    )


def _block_roles(block: Column) -> Column:
    """Expand a block of line classes to one role per line.

    1-6 heading, U its underline, T text, C code directive, D dropped blank, K code; a small
    letter marks the line after which the code fence closes.
    """
    first = F.substring(block, 1, 1)
    drop = F.substring(block, 2, 1) == "b"
    code = F.concat(
        F.lit("C"),
        F.when(drop, F.lit("D")).otherwise(""),
        F.repeat(F.lit("K"), F.length(block) - F.when(drop, 2).otherwise(1)),
    )
    closed = F.concat(
        F.substring(code, F.lit(1), F.length(block) - 1), F.lower(F.substring(code, -1, 1))
    )
    return (
        F.when(first == "c", closed)
        .when(first.rlike("[A-FP-U]"), F.concat(F.translate(first, "ABCDEFPQRSTU", "123456123456"), F.lit("U")))
        .otherwise("T")
    )


def _emit(line: Column, role: Column) -> Column:
    lang = strip(F.regexp_replace(line, rf"^\.\.[{WS}]+code-block::", ""))
    fence = F.concat(F.lit("```"), lang)
    # three leading blanks go, else the first tab wherever it stands
    code = F.regexp_replace(line, r"^(?:   |([^\t]*)\t)", "$1")
    end = F.lit("\n```")
    note = rf"(?i)^\.\.[{WS}]+({ADMONITIONS})::(.*)$"
    links = F.regexp_replace(line, rf":ref:`([^`<]+)[{WS}]+<([^>]+)>`", "[$1]($2)")
    links = F.regexp_replace(links, rf"`([^`]+)[{WS}]+<([^>]+)>`_", "[$1]($2)")
    text = F.when(
        line.startswith("..") & line.rlike(note),
        F.concat(
            F.lit("> **"), F.initcap(F.regexp_extract(line, note, 1)),
            F.lit(":** "), strip(F.regexp_extract(line, note, 2)),
        ),
    ).otherwise(F.when(F.contains(line, F.lit("`")), links).otherwise(line))
    return (
        F.when(role == "T", text)
        .when(role == "K", code)
        .when(role == "k", F.concat(code, end))
        .when(role == "C", fence)
        .when(role == "c", F.concat(fence, end))
        .when(role == "d", F.lit("```"))
        .when(role.rlike("[1-6]"), F.concat(F.repeat(F.lit("#"), role.cast("int")), F.lit(" "), strip(line)))
    )


def rst_to_markdown(text: Column) -> Column:
    """Headings, code blocks, admonitions and links of reStructuredText as Markdown.

    Each line is classed by itself and its successor. A left-to-right regular expression over the
    string of classes then finds the blocks, which settles what an ordinary scan would settle with
    state: an underline belongs to the heading before it, and a code block swallows everything
    indented or blank, headings included.
    """

    def convert(lines: Column) -> Column:
        classes = F.array_join(
            F.zip_with(lines, F.slice(lines, 2, F.size(lines)), _line_class), ""
        )
        blocks = F.regexp_extract_all(classes, F.lit("[A-FP-U].|cb?[biP-U]*|."), F.lit(0))
        roles = F.array_join(F.transform(blocks, _block_roles), "")
        return F.array_join(
            F.zip_with(lines, F.regexp_extract_all(roles, F.lit("."), F.lit(0)), _emit), "\n"
        )

    return let(split_lines(text), convert)
