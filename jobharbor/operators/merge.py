"""Keyed merges, group replacement and append-only logs as plain DataFrame transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobharbor.functions import text as X
from jobharbor.functions.frames import once
from jobharbor.functions.members import without


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under ``order``.

    Spark keeps one candidate per key and task before the shuffle (window group limit), so a key
    holding a large share of the rows does not travel to one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


WORD = 64  # column flags per number


def is_listed(flags: str, position: int) -> str:
    """SQL: whether the column at ``position`` is flagged."""
    return f"getbit({flags}[{position // WORD}], {position % WORD}) = 1"


def listed_columns(rows: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Which of ``columns`` any row of a group carried, as bits in the array ``listed``.

    ``rows`` has the carried names in ``fields``. The places of a row's names are looked up once. The union of a
    group is a bitwise or, begun before the shuffle: of a group a task sends one row of a few numbers and no names.
    """
    known = ", ".join(f"'{c}'" for c in columns)
    numbers = range(-(-len(columns) // WORD))
    none = ", ".join(f"'_w{w}', 0L" for w in numbers)
    bit = ", ".join(f"'_w{w}', m._w{w} | if(p >= 0 AND p div {WORD} = {w}, shiftleft(1L, p % {WORD}), 0L)" for w in numbers)
    at = f"transform(fields, n -> int(array_position(array({known}), n) - 1))"
    bits = once(rows.select(*groups, "fields"), bits=F.expr(f"aggregate({at}, named_struct({none}), (m, p) -> named_struct({bit}))"))
    union = bits.groupBy(*groups).agg(*[F.bit_or(f"bits._w{w}").alias(f"_w{w}") for w in numbers])
    return union.select(*groups, F.array(*[f"_w{w}" for w in numbers]).alias("listed"))


def batch_statement(
    rows: DataFrame, key: str, groups: Sequence[str], columns: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """One row per key and group: key, groups, the record in ``row``, the column flags in ``listed``."""
    single = latest_per_key(rows, [*groups, key], order)
    with_flags = single.join(listed_columns(rows, groups, columns), list(groups))
    return with_flags.select(key, *groups, "row", "listed")


def pack_row(record: str, columns: Sequence[str]) -> Column:
    """A record (a struct of numbers, texts and times) as JSON text of the columns that are not null.

    Rows of a wide table have few values. Sorted or grouped as structs they take the room of all columns in memory, however well they compress.
    """
    return F.expr("to_json(named_struct(" + ", ".join(f"'{c}', cast({record}.`{c}` AS string)" for c in columns) + "))")


def packed_schema(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def unpack_row(rows: DataFrame, packed: str, columns: Sequence[T.StructField]) -> DataFrame:
    """The columns of a packed record in place of it; one parse a row, and no shuffle, so the rows keep their order."""
    opened = rows.withColumn("_raw", F.from_json(packed, packed_schema([f.name for f in columns])))
    values = [F.col(f"_raw.`{f.name}`").cast(f.dataType).alias(f.name) for f in columns]
    names = {f.name for f in columns}
    return opened.select(*values, *[F.col(f"`{c}`") for c in rows.columns if c != packed and c not in names])


def fold_statements(rows: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], packed: bool = False) -> DataFrame:
    """Several statements on one key reduced to one with the same effect: key, ``order`` of the last, row, listed, stamps.

    Of every column the value of the last statement that lists it counts, so the result doesn't depend on how statements are batched or in which order
    they come. Of statements on a key that list the same columns only the last has an effect, so a key gathers no more rows than there are different sets
    of columns, however often it was fetched. ``stamps`` has one entry for each statement that still decides a column: its
    ``order`` and the flags of those columns. With ``packed`` the records are, and stay, texts made by ``pack_row``.
    """
    rows = latest_per_key(rows, [key, "listed"], [F.desc(c) for c in order])

    row = ", ".join(
        f"'{c}', if({is_listed('later.listed', i)}, later.row.`{c}`, earlier.row.`{c}`)"
        for i, c in enumerate(columns)
    )
    kept = ", ".join(f"'{c}', later.`{c}`" for c in order)
    either = "zip_with(earlier.listed, later.listed, (a, b) -> a | b)"
    then = f"(earlier, later) -> named_struct({kept}, 'row', named_struct({row}), 'listed', {either})"

    steps = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*order, "row", "listed"))).alias("_steps")
    )
    rest, first, made = "slice(_steps, 2, size(_steps))", "_steps[0]", "acc -> acc"
    if packed:
        place = lambda s: ", ".join(f"'{c}', {s}.`{c}`" for c in order)
        opened = lambda s: f"named_struct({place(s)}, 'row', from_json({s}.row, '{packed_schema(columns)}'), 'listed', {s}.listed)"
        rest, first = f"transform({rest}, s -> {opened('s')})", opened(first)
        made = f"acc -> named_struct({place('acc')}, 'row', to_json(acc.row), 'listed', acc.listed)"
    folded = F.expr(f"if(size(_steps) = 1, _steps[0], aggregate({rest}, {first}, {then}, {made}))")
    # a statement decides the columns it lists and no later one does
    taken = "aggregate(slice(_steps, i + 2, size(_steps)), transform(x.listed, w -> 0L), (a, y) -> zip_with(a, y.listed, (p, q) -> p | q))"
    own = f"if(i + 1 = size(_steps), x.listed, zip_with(x.listed, {taken}, (p, q) -> p & ~q))"
    place = ", ".join(f"'{c}', x.`{c}`" for c in order)
    stamps = F.expr(f"filter(transform(_steps, (x, i) -> named_struct({place}, 'listed', {own})), s -> exists(s.listed, w -> w <> 0))")
    return steps.select(key, folded.alias("_s"), stamps.alias("stamps")).select(key, "_s.*", "stamps")


def upsert_stamped(target: DataFrame, statements: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], stamps: str) -> DataFrame:
    """Keyed partial upsert of packed records whose result doesn't depend on the order in which statements arrive: like ``fold_statements``.

    ``target`` has key, columns and, in the column ``stamps``, which statement decided which columns; it is taken as the statements that made it. A
    column that no statement listed is null; a listed one takes the last value even if that is null. Statements, and the result, have their records packed.
    """
    earlier = target.select(key, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_record"), F.explode(stamps).alias("_s"))
    earlier = earlier.select(key, *[F.col(f"_s.`{c}`") for c in order], pack_row("_record", columns).alias("row"), "_s.listed")
    return fold_statements(earlier.unionByName(statements.select(*earlier.columns)), key, columns, order, packed=True)


def upsert_partial(
    target: DataFrame, statement: DataFrame, key: str, columns: Sequence[str], always: Sequence[str]
) -> DataFrame:
    """Insert new keys; on existing ones replace the listed columns and ``always``. For targets without stamps: statements must come in order.

    ``statement`` has one row per key with its record in ``row`` and its column flags in
    ``listed``. A column the batch did not list keeps its old value; a listed one takes the new
    value even if that is null.
    """
    merged = target.alias("old").join(
        statement.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer"
    )
    matched = f"new.`{key}` IS NOT NULL"
    picks = {
        c: f"if({matched} AND {is_listed('new.listed', i)}, new.row.`{c}`, old.`{c}`)"
        for i, c in enumerate(columns)
    }
    picks |= {c: f"if({matched}, new.`{c}`, old.`{c}`)" for c in always}
    picks[key] = f"coalesce(new.`{key}`, old.`{key}`)"
    return merged.selectExpr(*[f"{picks[c]} AS `{c}`" for c in target.columns])


def replace_groups(
    target: DataFrame, batch: DataFrame, groups: DataFrame, by: Sequence[str]
) -> DataFrame:
    """Drop every group named in ``groups`` and add the batch.

    ``groups`` is separate from the batch because an empty batch still clears its group.
    """
    kept = target.join(groups.select(*by).distinct(), list(by), "left_anti")
    return kept.unionByName(batch.select(*target.columns))


def record_snapshots(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Audit rows, the newest one per snapshot id."""
    both = log.unionByName(entries.select(*log.columns))
    return latest_per_key(both, ["snapshot_id"], [F.desc("fetched_utc"), F.desc("ok")])


def history_rows(rows: DataFrame, updated: Column) -> DataFrame:
    """Rows as JSON objects with their load time, for an append-only history table."""
    data = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return rows.select(data.alias("data"), updated.cast("timestamp_ntz").alias("updated_utc"))


# --- chunks and checkpoints -------------------------------------------------------------------


def build_chunks(documents: DataFrame, size: int, overlap: int, processed_ts: Column) -> DataFrame:
    """Chunk rows of ``documents`` (path, text, content_hash). The text itself is not repeated."""
    parts = documents.select(
        "path", "content_hash", F.posexplode(X.chunk_text(F.col("text"), size, overlap))
    )
    return parts.select(
        X.chunk_id(F.col("path"), F.col("pos")).alias("id"),
        F.col("path").alias("source_file"),
        F.col("pos").alias("chunk_index"),
        "content_hash",
        processed_ts.alias("processed_ts"),
        F.col("col").alias("chunk"),
    )


def replace_chunks(live: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Remove the chunks of the files in ``changed`` (path), then add the new ones. Live chunks of files that a filter clears don't move."""
    stale = changed.select(F.col("path").alias("source_file")).distinct()
    return without(live, stale, "source_file").unionByName(new.select(*live.columns))


def chunk_count(length: Column, size: int, overlap: int) -> Column:
    step = X.check_chunking(size, overlap)
    return F.ceil(length / step).cast("int")


def checkpoint_rows(documents: DataFrame, size: int, overlap: int, processed_ts: Column, length: str | None = None) -> DataFrame:
    """Checkpoint entries computed from the texts, or from the column that has their ``length``, without gathering the chunk rows again."""
    count = chunk_count(F.length("text") if length is None else F.col(length), size, overlap)
    path = F.col("path")
    ids = F.transform(F.sequence(F.lit(0), count - 1), lambda i: X.chunk_id(path, i))
    return documents.select(
        "path",
        "content_hash",
        processed_ts.alias("processed_ts"),
        count.alias("chunks"),
        F.when(count > 0, ids).otherwise(F.array().cast("array<string>")).alias("chunk_ids"),
    )


def merge_by_key(state: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """State with updated rows replacing older ones of the same key; the rest stays."""
    kept = state.join(updates.select(key), key, "left_anti")
    return kept.unionByName(updates.select(*state.columns))
