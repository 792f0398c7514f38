"""Conversation structure repair by a dynamic program over persistent audits.

A conversation's rows, in the order of their turns, are edited so that the
initials of its roles read ``(s?(ua)+)?``: Keep, Rerole (to user or assistant),
Delete and Insert (an empty turn of either), each with a cost. Per row and state of
that pattern the program keeps the cheapest edits; of equally cheap ones the
ASCII-least audit, the string of the edits' initials.

Audits are not copied: an audit is a node that names its last edit and the node
before it, so all candidates share their prefixes. Every node has ancestors at
distances 1, 2, 4, ... and the rolling hash of its whole string, so the longest
common prefix of two audits is found by descending both in steps of powers of
two. Where the prefixes found equal by hash are not the same node, they are
compared letter by letter: a hash collision cannot decide a tie.

On Spark: rows are numbered inside their conversation over range partitions (no
conversation is one task's). Pieces of ``SEGMENT`` rows are solved apart, once per
state that they can be entered in; one pass per conversation then chains the
pieces, its nodes being whole pieces, so it handles rows / ``SEGMENT`` entries. The
audit of a conversation is one string by contract, and its digest is sequential,
so one task streams a conversation's lines through the hash; it holds one
batch at a time.

Defined results: a null role, text, turn or conversation reads as one space (null
conversations are one conversation; null turns come first and do not count in
``gaps``). Rows with equal turns are ordered by role, then by the digest of the text;
equal rows are interchangeable. An empty role has no initial. A conversation
without rows has zeros, an empty audit and the digest of nothing. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize

SEGMENT = 2048
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: States of the role pattern: nothing yet, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to, from each state.
STEP = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that may be written in each state (never system), and where it leads.
NEXT = {NONE: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
FINAL = (NONE, ASSISTANT)
_MOD, _BASE = (1 << 61) - 1, 1_000_003


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Audit:
    """One persistent node: ``piece`` (a letter, or a segment's letters) after the audit ``up[0]``."""

    __slots__ = ("up", "depth", "hash", "piece", "note")

    def __init__(self, parent=None, piece: str = "", note: str = ""):
        self.piece, self.note = piece, note
        if parent is None:
            self.up, self.depth, self.hash = (), 0, 0
            return
        self.depth = parent.depth + 1
        h = parent.hash
        for c in piece:
            h = (h * _BASE + ord(c)) % _MOD
        self.hash = h
        up, k = [parent], 0
        while k < len(up[k].up):  # the ancestor at 2**(k+1) is the one at 2**k of the one at 2**k
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)

    def at(self, depth: int) -> Audit:
        node, back = self, self.depth - depth
        k = 0
        while back:
            if back & 1:
                node = node.up[k]
            back >>= 1
            k += 1
        return node

    def pieces(self) -> list:
        out, node = [], self
        while node.depth:
            out.append(node)
            node = node.up[0]
        return out[::-1]

    def text(self) -> str:
        return "".join([n.piece for n in self.pieces()])


def _same(a: Audit, b: Audit) -> bool:
    """Whether two audits of equal depth and hash are equal, by their letters."""
    while a is not b:
        if a.piece != b.piece:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Audit, b: Audit) -> bool:
    """Whether the audit ``a`` is ASCII-less than ``b``. Nodes of one kind: letters, or pieces of which
    none is a proper prefix of another at its place."""
    if a is b:
        return False
    shorter = a.depth < b.depth
    m = min(a.depth, b.depth)
    x, y = a.at(m), b.at(m)
    if x is y or x.hash == y.hash and _same(x, y):
        return shorter
    for k in range(max(len(x.up), 1) - 1, -1, -1):
        # stay below the first difference: go up only while the prefixes differ
        if k < len(x.up) and x.up[k] is not y.up[k] and not (x.up[k].hash == y.up[k].hash and _same(x.up[k], y.up[k])):
            x, y = x.up[k], y.up[k]
    return x.piece < y.piece


def _offer(layer: dict, state: int, cost: int, parent: Audit, piece: str, note: str) -> bool:
    """Keep the edit in ``layer`` if it is cheaper, or as cheap and ASCII-less."""
    old = layer.get(state)
    if old is not None and old[0] < cost:
        return False
    node = Audit(parent, piece, note)
    if old is not None and old[0] == cost and not less(node, old[1]):
        return False
    layer[state] = (cost, node)
    return True


def with_inserts(layer: dict, costs: Costs) -> dict:
    """``layer`` with every state that insertions reach for less."""
    changed = True
    while changed:
        changed = False
        for state in list(layer):
            cost, node = layer[state]
            initial, to = NEXT[state]
            if to not in layer or layer[to][0] >= cost + costs.insert:
                changed |= _offer(layer, to, cost + costs.insert, node, INSERT, initial)
    return layer


def solve(rows, entry: int, costs: Costs) -> dict:
    """Cheapest edits of ``rows`` (initial, fault) from state ``entry``: exit state ->
    (cost, audit). A node's note tells what its letter does: K or D, the written
    role's initial for R (upper case) and I (lower case)."""
    layer = {entry: (0, Audit())}
    for initial, fault in rows:
        layer, before = {}, with_inserts(layer, costs)
        for state, (cost, node) in before.items():
            _offer(layer, state, cost + costs.delete, node, DELETE, DELETE)
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (costs.truncated if fault == "truncated" else 0)
            to = STEP.get((state, initial))
            if to is not None:
                _offer(layer, to, more, node, KEEP, KEEP)
            written, to = NEXT[state]
            _offer(layer, to, more + costs.rerole, node, REROLE, written.upper())
    return layer


def close(layer: dict, costs: Costs) -> tuple:
    """The cheapest complete ``(cost, audit)`` of a layer after the last row."""
    layer = with_inserts(layer, costs)
    best = None
    for state in FINAL:
        if state in layer:
            cost, node = layer[state]
            if best is None or cost < best[0] or cost == best[0] and less(node, best[1]):
                best = (cost, node)
    return best


# ------------------------------------------------------------------ on Spark
_BLANK = r"^[\x20\x09-\x0D]*\z"
_TRUNCATED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"


def _read(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(df: DataFrame) -> DataFrame:
    """The rows after the drill: by ``crc32("conv_id:turn") % 20`` 0 drops a row, 1 empties its
    text, 2 removes its ``.!?``, 3 repeats it and 4 makes it the user's."""
    fate = F.crc32(F.concat(_read("conv_id"), F.lit(":"), _read("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(_read("text"), ".!?", "")).otherwise(_read("text"))
    hurt = df.select(F.col("conv_id"), F.col("turn"), F.when(fate == 4, "user").otherwise(_read("role")).alias("role"), text.alias("text"),
                     F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("_copies"))
    return hurt.where("_copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).drop("_copies", "_copy")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows in the order of their turns: ``at`` grows along the order over all range
    partitions; equal rows are spread by a row number, so neither a long
    conversation nor one row repeated many times is one task's."""
    spark = rows.sparkSession
    t = rows.select(_read("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _read("role").alias("role"), _read("text").alias("text"))
    t = t.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest", "tie"]
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    t = t.repartitionByRange(slices, *order).sortWithinPartitions(*order).drop("tie")
    t = t.withColumn("at", F.monotonically_increasing_id()).withColumn("slice", F.spark_partition_id())
    return materialize(t, "turns")


def _faults(turns: DataFrame) -> DataFrame:
    """``(conv, place, at, initial, fault)`` without texts."""
    blank = F.col("text").rlike(_BLANK)
    light = materialize(turns.select("conv", "turn", "slice", "at", "role", "digest", F.substring("role", 1, 1).alias("initial"),
                                     blank.alias("blank"), F.col("text").rlike(_TRUNCATED).alias("cut")), "turn-marks")
    # the first row of each role and text; at is unique, so no key of the join is hot
    first = light.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    spans = light.groupBy("conv", "slice").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("conv", "slice", (F.coalesce(before, F.lit(0)) - F.col("begin")).alias("shift"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise(""))
    out = light.join(first, "at", "left").join(spans, ["conv", "slice"]).select(
        "conv", (F.col("at") + F.col("shift")).alias("place"), "at", "initial", fault.alias("fault"))
    return materialize(out, "turn-faults")


_SOLVED = ("conv string, seg long, opening string, closing string, illegal long, blank long, duplicate long, truncated long, "
           "ways array<struct<entry: int, exit: int, cost: long, audit: string, notes: string>>")
_LEGAL = ("su", "ua", "au")


def _segments(faults: DataFrame, costs: Costs) -> DataFrame:
    """Every piece of ``SEGMENT`` rows solved from each state that it can be entered in."""
    fixed = astuple(costs)

    def finish(conv, seg, initials, kinds, price):
        rows = list(zip(initials, kinds))
        ways = []
        for entry in (NONE, SYSTEM, USER, ASSISTANT) if seg else (NONE,):
            for out, (cost, node) in solve(rows, entry, price).items():
                nodes = node.pieces()
                ways.append({"entry": entry, "exit": out, "cost": cost, "audit": "".join([n.piece for n in nodes]),
                             "notes": "".join([n.note for n in nodes])})
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
        return (conv, seg, initials[0], initials[-1], illegal, *(kinds.count(f) for f in ("blank", "duplicate", "truncated")), ways)

    def run(batches):
        price = Costs(*fixed)
        key, initials, kinds = None, [], []
        for b in batches:
            out = []
            for conv, seg, initial, fault in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (conv, seg) != key:
                    if key is not None:
                        out.append(finish(*key, initials, kinds, price))
                    key, initials, kinds = (conv, seg), [], []
                initials.append(initial)
                kinds.append(fault)
            if out:
                yield _rows_batch(out, _SOLVED)
        if key is not None:
            yield _rows_batch([finish(*key, initials, kinds, price)], _SOLVED)

    rows = faults.select("conv", F.floor(F.col("place") / SEGMENT).cast("long").alias("seg"), "place", "initial", "fault")
    rows = rows.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "place").select("conv", "seg", "initial", "fault")
    return materialize(rows.mapInArrow(run, _SOLVED), "turn-segments")


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(),
          "array<struct<entry: int, exit: int, cost: long, audit: string, notes: string>>": pa.list_(pa.struct(
              [("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("notes", pa.string())])),
          "array<struct<seg: long, entry: int, exit: int>>": pa.list_(pa.struct(
              [("seg", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())]))}


def _rows_batch(out: list, schema: str):
    fields = [f.strip().split(" ", 1) for f in schema.replace("struct<entry: int, exit: int, cost: long, audit: string, notes: string>", "W")
              .replace("struct<seg: long, entry: int, exit: int>", "P").split(", ")]
    kinds = {"array<W>": "array<struct<entry: int, exit: int, cost: long, audit: string, notes: string>>",
             "array<P>": "array<struct<seg: long, entry: int, exit: int>>"}
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kinds.get(t, t)]) for c, (_, t) in zip(zip(*out), fields)],
                                      names=[n for n, _ in fields])


_CHAINED = ("conv string, illegal long, blank long, duplicate long, truncated long, cost long, audit string, tail string, "
            "path array<struct<seg: long, entry: int, exit: int>>")


def _chain(solved: DataFrame, costs: Costs) -> DataFrame:
    """The cheapest way through each conversation's pieces. One piece is handled at a
    time; of its ways the best per exit state stay."""
    fixed = astuple(costs)

    def finish(conv, state, price):
        layer, sums = state["layer"], state["sums"]
        cost, node = close(layer, price)
        nodes = node.pieces()
        path = [n.note for n in nodes if not isinstance(n.note, str)]
        tail = "".join([n.note for n in nodes if isinstance(n.note, str)])
        return (conv, *sums, cost, "".join([n.piece for n in nodes]), tail,
                [{"seg": s, "entry": a, "exit": z} for s, a, z in path])

    def run(batches):
        price = Costs(*fixed)
        conv_now, state = None, None
        for b in batches:
            out = []
            for conv, seg, opening, closing, *sums, ways in zip(*(b.column(k).to_pylist() for k in range(9))):
                if conv != conv_now:
                    if state is not None:
                        out.append(finish(conv_now, state, price))
                    conv_now, state = conv, {"layer": {NONE: (0, Audit())}, "sums": [0, 0, 0, 0], "closing": None}
                state["sums"] = [x + y for x, y in zip(state["sums"], sums)]
                if state["closing"] is not None:
                    state["sums"][0] += state["closing"] + opening not in _LEGAL
                state["closing"] = closing
                layer = {}
                for w in ways:
                    if w["entry"] in state["layer"]:
                        cost, node = state["layer"][w["entry"]]
                        _offer(layer, w["exit"], cost + w["cost"], node, w["audit"], (seg, w["entry"], w["exit"]))
                state["layer"] = layer
            if out:
                yield _rows_batch(out, _CHAINED)
        if state is not None:
            yield _rows_batch([finish(conv_now, state, price)], _CHAINED)

    return materialize(solved.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(run, _CHAINED), "turn-audits")


def _edits(faults: DataFrame, solved: DataFrame, chained: DataFrame) -> DataFrame:
    """``(conv, at, edit)``: each row's edit, its letter after those of the rows inserted before it."""
    path = chained.select("conv", F.explode("path").alias("p")).select("conv", "p.seg", "p.entry", "p.exit")
    ways = solved.select("conv", "seg", F.explode("ways").alias("w")).select("conv", "seg", "w.entry", "w.exit", "w.notes")
    each = path.join(ways, ["conv", "seg", "entry", "exit"]).select(
        "conv", "seg", F.posexplode(F.regexp_extract_all("notes", F.lit("([ua]*[KDUA])"), F.lit(1))).alias("k", "edit"))
    return each.select("conv", (F.col("seg") * SEGMENT + F.col("k")).alias("place"), "edit").join(
        faults.select("conv", "place", "at"), ["conv", "place"]).select("conv", "at", "edit")


_NAMES = {"u": "user", "a": "assistant"}


def _lines(edit: str, role: str | None, text: str | None):
    """The repaired ``(role, text)`` rows of one edit."""
    for c in edit:
        if c in "ua":
            yield _NAMES[c], ""
        elif c != "D":
            yield role if c == "K" else _NAMES[c.lower()], text


def _streamed(turns: DataFrame, edits: DataFrame, chained: DataFrame) -> DataFrame:
    """Edits and rows of each conversation next to each other, in order."""
    last = F.lit(2**63 - 1)
    asked = edits.unionByName(chained.where("tail <> ''").select("conv", last.alias("at"), F.col("tail").alias("edit")))
    none = F.lit(None).cast("string")
    both = asked.select("conv", "at", F.lit(0).alias("kind"), "edit", none.alias("role"), none.alias("text")).unionByName(
        turns.select("conv", "at", F.lit(1).alias("kind"), none.alias("edit"), "role", "text"))
    return both.repartition("conv").sortWithinPartitions("conv", "at", "kind").select("conv", "at", "edit", "role", "text")


def _each_line(batches):
    """``(conv, role, text)`` of the repaired rows, in order; an edit comes just before its row."""
    asked = None
    for b in batches:
        out = []
        for conv, at, edit, role, text in zip(*(b.column(k).to_pylist() for k in range(5))):
            if edit is None:
                out += [(conv, r, t) for r, t in _lines(asked, role, text)]
            elif at == 2**63 - 1:
                out += [(conv, r, t) for r, t in _lines(edit, None, None)]
            else:
                asked = edit
        yield out


def _digests(stream: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` of conversations with repaired rows."""
    def run(batches):
        conv_now, sha = None, None
        for lines in _each_line(batches):
            out = []
            for conv, role, text in lines:
                if conv != conv_now:
                    if sha is not None:
                        out.append((conv_now, sha.hexdigest()))
                    conv_now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield _rows_batch(out, "conv string, repaired_sha256 string")
        if sha is not None:
            yield _rows_batch([(conv_now, sha.hexdigest())], "conv string, repaired_sha256 string")

    return map_texts(stream, run, "conv string, repaired_sha256 string")


class Repair:
    """The repair of ``rows`` (conv_id, turn, role, text)."""

    def __init__(self, rows: DataFrame, costs: Costs = Costs()):
        self.turns = _numbered(rows)
        faults = _faults(self.turns)
        solved = _segments(faults, costs)
        self.chained = _chain(solved, costs)
        self.edits = _edits(faults, solved, self.chained)

    def repaired(self) -> DataFrame:
        """``(conv_id, role, text)``: the repaired rows, those of one conversation in order."""
        def run(batches):
            for lines in _each_line(batches):
                if lines:
                    yield _rows_batch(lines, "conv string, role string, text string")

        return map_texts(_streamed(self.turns, self.edits, self.chained), run, "conv string, role string, text string").select(
            F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id"), "role", "text")

    def report(self, ids: DataFrame) -> DataFrame:
        """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every
        conversation in ``ids``."""
        gaps = self.turns.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
        sha = _digests(_streamed(self.turns, self.edits, self.chained))
        asked = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", _read("conv_id"))
        sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        return (asked.join(gaps, "conv", "left").join(self.chained.drop("path", "tail"), "conv", "left").join(sha, "conv", "left")
                     .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums],
                             F.coalesce("audit", F.lit("")).alias("audit"),
                             F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
