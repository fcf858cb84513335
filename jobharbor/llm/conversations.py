"""Repair of conversations whose rows were damaged.

Every row of a conversation becomes one sign: what its role begins with and whether it is cut off, or that it must go. The signs of a conversation
are its signature. The cheapest repair of what is left of a signature depends on those signs and on the grammar's state alone, so signatures
share their endings: they are range-sorted by their reversed signs, and a task that reads them in that order keeps the nodes from the end to the sign it is at. A node
is made once for all the signatures of a task that end alike; it holds for each state the cost to go, the first letter of the best
audit and the state that follows, which is the best audit suffix written as a link. Only the nodes of one signature are held at a time.

The best audit needs no comparison of suffixes: from a state every letter leads to one state alone, so of two equally cheap repairs the one with
the lesser first letter is the lesser.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from jobharbor.llm.common import join_weighted, stored

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
BLANK, ENDS = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

# The grammar (s?(ua)+)?: nothing read yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that an inserted or reroled row leads to, and its role.
MADE = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
FINAL = (START, ASSISTANT)
NEVER = 1 << 60

#: Signs: a row that must go; a whole row by the initial of its role; a row cut off, in capitals.
GONE, OTHER = "d", "x"


# --- damage -----------------------------------------------------------------------------------


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, copies: rows as damaged by the checksum of ``conv:turn``; nulls count as one space, but a null turn stays null.

    0 drops the row (no copies), 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), blank(conv).alias("c"), blank(turn).alias("t"))
    kind = F.crc32(F.concat_ws(":", "c", "t").cast("binary")) % 20
    kinds = own.withColumn("kind", kind)
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return kinds.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.cast("bigint").alias("copies")
    )


# --- signatures -------------------------------------------------------------------------------

ORDER = ["conv", "turn", "role", "digest"]


def _signed(rows: DataFrame) -> DataFrame:
    """One row for each conv, turn, role and text, with its copies, its first fault and its sign.

    Rows alike are counted before the shuffle; all but the first of them are duplicates. Of rows alike at several turns those behind the earliest are.
    """
    alike = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    digest = F.substring(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256), 1, 32)
    alike = stored(alike.withColumn("digest", digest).withColumn("place", F.struct(F.col("turn").isNotNull().alias("set"), "turn")), "talk-rows")
    there = alike.where("copies > 0")
    seen = there.groupBy(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("c"), F.col("conv").isNull().alias("none"), "digest")
    seen = stored(seen.agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1"), "talk-seen")
    keys = ["c", "none", "digest"]
    keyed = there.select("*", F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("c"), F.col("conv").isNull().alias("none"))
    later = join_weighted(keyed.select(*keys, "turn", "place"), seen, keys, "times").where("place > first")
    later = later.select(*[F.col(k).alias(f"{k}_") for k in (*keys, "turn")], F.lit(True).alias("again"))
    # one row a row of the other side, so no key is hot
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in (*keys, "turn")]
    marked = keyed.join(later, reduce(lambda a, b: a & b, same), "left").select("conv", "turn", "role", "text", "digest", "copies", "again")
    fault = (
        F.when(~F.col("text").rlike(BLANK), "blank")
        .when(F.col("again"), "duplicate")
        .when(~F.col("text").rlike(ENDS), "truncated")
    )
    initial = F.substring("role", 1, 1)
    sign = F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    faulty = marked.withColumn("fault", fault)
    sign = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(sign)).otherwise(sign)
    return stored(faulty.withColumn("sign", sign), "talk-signs")


STATS = "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first_turn {0}, last_turn {0}, first_role string, last_role string"
LEGAL = ("su", "ua", "au")


def _pieces(signs: DataFrame) -> DataFrame:
    """conv, part and the figures of each stretch of a conversation's rows that one task holds.

    Rows are range-sorted, so a conversation with a large part of all rows lies in many tasks.
    """
    turn = signs.schema["turn"].dataType
    schema = T.StructType([T.StructField("conv", signs.schema["conv"].dataType), *T.StructType.fromDDL(f"part bigint, {STATS.format(turn.simpleString())}").fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches):
        part = TaskContext.get().partitionId()
        state: dict | None = None
        done: list[dict] = []

        def close():
            done.append({**state, "part": part, "signature": "".join(state["signature"])})

        def out():
            made = pa.RecordBatch.from_pylist(done, schema=arrow)
            done.clear()
            return made

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv", "turn", "role", "sign", "fault", "copies"))
            for conv, turn, role, sign, fault, copies in zip(*columns, strict=True):
                if state is None or conv != state["conv"]:
                    if state is not None:
                        close()
                    state = {"conv": conv, "signature": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
                    state |= {"first_turn": None, "last_turn": None, "first_role": role[:1], "last_role": None}
                if state["last_role"] is not None:
                    state["illegal"] += state["last_role"] + role[:1] not in LEGAL
                # copies follow one another: alike initials are never a legal pair
                state["illegal"] += copies - 1
                state["last_role"] = role[:1]
                if fault == "blank":
                    state["blank"] += copies
                else:
                    state["duplicate"] += copies - 1
                    if fault:
                        state[fault] += 1
                state["signature"].append(sign + GONE * (copies - 1))
                if turn is not None:
                    if turn != state["last_turn"]:
                        state["turns"] += 1
                    state["first_turn"] = turn if state["first_turn"] is None else state["first_turn"]
                    state["last_turn"] = turn
            yield out()
        if state is not None:
            close()
            yield out()

    narrow = signs.select("conv", "turn", "role", "digest", "sign", "fault", "copies")
    return narrow.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, schema)


def signatures(signs: DataFrame) -> DataFrame:
    """conv, signature, gaps, blank, duplicate, truncated, illegal: the stretches of each conversation put together, at most one a task."""
    pieces = stored(_pieces(signs), "talk-pieces")
    names = [f.name for f in pieces.schema.fields if f.name not in ("conv", "part")]
    together = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", *names))).alias("p"))
    total = lambda name: F.aggregate(F.transform("p", lambda x: x[name]), F.lit(0).cast("bigint"), lambda a, b: a + b)
    pairs = "slice(zip_with(p, slice(p, 2, size(p)), (x, y) -> struct(x AS x, y AS y)), 1, size(p) - 1)"
    legal = ", ".join(f"'{x}'" for x in LEGAL)
    # where two stretches meet: the pair of roles, and a turn that both have
    between = F.expr(f"size(filter({pairs}, q -> concat(q.x.last_role, q.y.first_role) NOT IN ({legal})))").cast("bigint")
    shared = F.expr(f"size(filter({pairs}, q -> q.x.last_turn = q.y.first_turn))").cast("bigint")
    least, most = F.array_min(F.transform("p", lambda x: x["first_turn"])), F.array_max(F.transform("p", lambda x: x["last_turn"]))
    return together.select(
        "conv",
        F.array_join(F.transform("p", lambda x: x["signature"]), "").alias("signature"),
        F.coalesce((most - least).cast("bigint") + 1 - (total("turns") - shared), F.lit(0).cast("bigint")).alias("gaps"),
        total("blank").alias("blank"),
        total("duplicate").alias("duplicate"),
        total("truncated").alias("truncated"),
        (total("illegal") + between).alias("illegal"),
    )


# --- automaton --------------------------------------------------------------------------------


def _node(options: list[dict[str, tuple[int, int]]]) -> list[tuple[int, str, int]]:
    """For each state (cost to go, letter, state that follows); ``options`` has letter -> (cost, state) of what reads or ends a sign.

    Inserting leads to another state of the same node.
    """
    costs = [min((c for c, _ in o.values()), default=NEVER) for o in options]
    for _ in range(STATES):
        costs = [min(c, INSERT + costs[MADE[q][0]]) for q, c in enumerate(costs)]
    node = []
    for q, cost in enumerate(costs):
        ways = {letter: (c, then) for letter, (c, then) in options[q].items() if c == cost}
        if INSERT + costs[MADE[q][0]] == cost:
            ways["I"] = (cost, MADE[q][0])
        letter = min(ways)
        node.append((cost, letter, ways[letter][1]))
    return node


#: The node behind the last sign; the empty letter ends the audit.
END = _node([{"": (0, q)} if q in FINAL else {} for q in range(STATES)])


def before(sign: str, node: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The node of ``sign`` in front of ``node``."""
    options = []
    for q in range(STATES):
        ways = {"D": (DELETE + node[q][0], q)}
        if sign != GONE:
            extra = TRUNCATED if sign.isupper() else 0
            to, _ = MADE[q]
            ways["R"] = (REROLE + extra + node[to][0], to)
            if (q, sign.lower()) in FOLLOWS:
                to = FOLLOWS[q, sign.lower()]
                ways["K"] = (extra + node[to][0], to)
        options.append(ways)
    return _node(options)


def audit(nodes: list) -> str:
    """The best audit of a signature whose nodes are listed from the end."""
    out, state, at = [], START, len(nodes) - 1
    while True:
        _, letter, then = nodes[at][state]
        if not letter:
            return "".join(out)
        out.append(letter)
        state = then
        if letter != "I":
            at -= 1


def repairs(signed: DataFrame) -> DataFrame:
    """conv, cost, audit of conversations (conv, signature).

    The conversations are sorted by their reversed signature, then by conversation, so that one signature that very many have is spread over tasks too.
    """
    schema = T.StructType([T.StructField("conv", signed.schema["conv"].dataType), *T.StructType.fromDDL("cost bigint, audit string").fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches):
        nodes, last, best = [END], "", ""
        for batch in batches:
            out = []
            for conv, ending in zip(batch.column("conv").to_pylist(), batch.column("ending").to_pylist(), strict=True):
                if ending != last:
                    same = next((i for i, (a, b) in enumerate(zip(ending, last)) if a != b), min(len(ending), len(last)))
                    del nodes[same + 1 :]
                    for sign in ending[same:]:
                        nodes.append(before(sign, nodes[-1]))
                    best = audit(nodes)
                    last = ending
                out.append({"conv": conv, "cost": nodes[-1][START][0], "audit": best})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    ending = signed.select("conv", F.reverse("signature").alias("ending"))
    return ending.repartitionByRange("ending", "conv").sortWithinPartitions("ending", "conv").mapInArrow(run, schema)


# --- repaired texts ---------------------------------------------------------------------------


class Repair:
    """Applies an audit to rows in order and hands out the lines of the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _made(self) -> str:
        self.state, role = MADE[self.state]
        return role

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield f"{self._made()}:"

    def row(self, role: str, text: str, copies: int):
        for _ in range(copies):
            yield from self.inserted()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "R":
                yield f"{self._made()}:{text}"
            elif letter == "K":
                self.state = FOLLOWS[self.state, role[:1]]
                yield f"{role}:{text}"


def _digests(signs: DataFrame, best: DataFrame) -> DataFrame:
    """conv, repaired_sha256. A digest has to read a conversation in order, so its rows meet in one task; they are streamed, one batch at a time."""
    verdict = best.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(signs.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("copies"))
    lines = signs.select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "copies")
    order = ["conv", "kind", "turn", "role", "digest"]
    schema = T.StructType([T.StructField("conv", signs.schema["conv"].dataType), T.StructField("repaired_sha256", T.StringType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches):
        conv = repair = digest = None
        empty = True

        def add(made):
            nonlocal empty
            for line in made:
                digest.update(line.encode("utf-8", "surrogatepass") if empty else b"\n" + line.encode("utf-8", "surrogatepass"))
                empty = False

        def out():
            add(repair.inserted())
            return {"conv": conv, "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            done = []
            for c, kind, role, text, copies in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "role", "text", "copies")), strict=True):
                if kind == 0:
                    if repair is not None:
                        done.append(out())
                    conv, repair, digest, empty = c, Repair(text), hashlib.sha256(), True
                else:
                    add(repair.row(role, text, copies))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if repair is not None:
            yield pa.RecordBatch.from_pylist([out()], schema=arrow)

    both = verdict.unionByName(lines).repartition("conv").sortWithinPartitions(*order)
    return both.mapInArrow(run, schema)


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, copies; see ``damage``): conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; those of one turn by role, then by the digest of role and text. A row's first fault counts: no text but white space; role and
    text seen earlier in the conversation; a last character that ends no sentence. A null conversation is one of its own. A conversation of which no row is left has
    zeros, an empty audit and the digest of the empty text. Rows alike in everything count as often as they are there. Very long texts are handed on and hashed
    one batch at a time. An empty table gives an empty result.
    """
    signs = _signed(rows)
    signed = stored(signatures(signs), "talk-signatures")
    best = stored(repairs(signed.select("conv", "signature")), "talk-repairs")
    digests = _digests(signs, best)
    whole = signed.drop("signature").withColumnRenamed("conv", "c")
    parts = [whole, best.withColumnRenamed("conv", "c1"), digests.withColumnRenamed("conv", "c2")]
    joined = reduce(lambda a, b: a.join(b, F.col("c").eqNullSafe(F.col(b.columns[0]))), parts)
    every = rows.select("conv").distinct()
    zero = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    found = every.join(joined.drop("c1", "c2"), F.col("conv").eqNullSafe(F.col("c")), "left")
    return found.select(
        "conv",
        *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
