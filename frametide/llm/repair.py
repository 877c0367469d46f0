"""Conversation structure repair by cost layers of reachable grammar states.

The roles of a repaired conversation form (s?(ua)+)?, a grammar of four states. A layer is the bitset of states that are reachable
at one cost; a turn's edits move bits from layer to layer: keep stays in its layer, other edits climb by their cost. Only a state's
least layer matters, and only eleven layers from a turn's lowest on, so these layers are one of few configurations. Steps between
configurations are worked out once and looked up after. The first layer that holds an accepting state at the end gives the cost; the
trace of the bits, with the order of their histories for ties, gives the audit.

A conversation is a stream of sorted rows. Memory is a few bytes a row for the trace and, for each state, one running digest of the
repaired text, so a conversation of any length passes; texts are never collected.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults; 0 is none
ROLES = {"u": "user", "a": "assistant"}

# States: 0 nothing yet, 1 after the system's turn, 2 after the user's, 3 after the assistant's. Bit q of a layer is state q.
START, ACCEPTING = 0b0001, 0b1001
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
WRITES = {0: "u", 1: "u", 2: "a", 3: "u"}  # the role that an edit writes in each state
#: A state further above the lowest is on no cheapest repair: two insertions and a deletion bring the lowest to where it can go.
WITHIN = 2 * INSERT + DELETE
REPORT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# ---------------------------------------------------------------- layers


def _inserted(layers: list[int]) -> list[int]:
    """The layers with insertions: a bit climbs by INSERT to the state that the written role leads to."""
    out = layers + [0] * (2 * INSERT)
    for c in range(len(out) - INSERT):
        for q in range(4):
            if out[c] >> q & 1:
                out[c + INSERT] |= 1 << NEXT[WRITES[q]][q]
    return out


def _lowest(layers: list[int]) -> tuple[int, ...]:
    """Each state in its lowest layer only."""
    seen, out = 0, []
    for bits in layers:
        out.append(bits & ~seen)
        seen |= bits
    while out and not out[-1]:
        out.pop()
    return tuple(out)


def _least(layers: tuple[int, ...], q: int) -> int:
    return next((c for c, bits in enumerate(layers) if bits >> q & 1), -1)


def _insertions(q: int, most: int = 2) -> Iterator[tuple[str, str, int]]:
    """(edits, roles written, state) for none up to `most` insertions."""
    edits = roles = ""
    for k in range(most + 1):
        if k:
            edits, roles, q = edits + "I", roles + WRITES[q], NEXT[WRITES[q]][q]
        yield edits, roles, q


class Steps:
    """The steps between configurations: (layers, states in the order of their histories) by kind of row, each worked out once.

    A kind is (role initial, delete required, truncated). A step has an id, the cost of its lowest layer, the configuration it leads
    to, and for each state reached (state, state before, edits, roles written, whether the row's own role stays).
    """

    def __init__(self):
        self.known: dict[tuple, tuple] = {}
        self.made: list[tuple] = []

    def step(self, config: tuple, kind: tuple[str, bool, bool]) -> tuple:
        found = self.known.get((config, kind))
        if found is None:
            found = self.known[config, kind] = self._work_out(config, kind)
        return found

    def _work_out(self, config: tuple, kind: tuple[str, bool, bool]) -> tuple:
        (layers, order), (initial, delete, truncated) = config, kind
        base = _inserted(list(layers))
        new = [0] * (len(base) + DELETE + REROLE + TRUNCATED)
        extra = TRUNCATED * truncated
        for c, bits in enumerate(base):
            new[c + DELETE] |= bits
            for q in range(4):
                if not delete and bits >> q & 1:
                    new[c + REROLE + extra] |= 1 << NEXT[WRITES[q]][q]
                    if q in NEXT.get(initial, {}):
                        new[c + KEEP + extra] |= 1 << NEXT[initial][q]
        low = next(c for c, bits in enumerate(new) if bits)
        reached = _lowest(new[low : low + WITHIN + 1])
        best: dict[int, tuple] = {}
        for place, before in enumerate(order):
            at = _least(layers, before)
            for edits, roles, q in _insertions(before):
                cost = at + INSERT * len(edits)
                options = [(cost + DELETE, q, "D", "", False)]
                if not delete:
                    options.append((cost + REROLE + extra, NEXT[WRITES[q]][q], "R", WRITES[q], False))
                    if q in NEXT.get(initial, {}):
                        options.append((cost + KEEP + extra, NEXT[initial][q], "K", "", True))
                for total, state, edit, role, kept in options:
                    if total - low == _least(reached, state):
                        key = (place, edits + edit)
                        if state not in best or key < best[state][0]:
                            best[state] = (key, (state, before, edits + edit, roles + role, kept))
        states = tuple(sorted(best, key=lambda q: best[q][0]))
        out = (len(self.made), low, (reached, states), [best[q][1] for q in states])
        self.made.append(out)
        return out


class Conversation:
    """One conversation as its rows stream by, in order."""

    def __init__(self, steps: Steps, id):
        self.steps, self.id = steps, id
        self.config, self.cost, self.trace = ((START,), (0,)), 0, array("i")
        self.digests = {0: hashlib.sha256()}
        self.faults = [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.turns, self.first, self.last = 0, None, None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            if self.turns == 0:
                self.first = turn
            if turn != self.last:
                self.turns, self.last = self.turns + 1, turn
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        id, low, self.config, moves = self.steps.step(self.config, (initial, fault in (BLANK, DUPLICATE), fault == CUT))
        self.cost += low
        self.trace.append(id)
        raw = text.encode("utf-8", "surrogatepass")
        digests = {}
        for state, before, edits, roles, kept in moves:
            digest = self.digests[before].copy()
            if roles or kept:
                lines = [f"{ROLES[r]}:".encode() for r in roles]
                if kept:
                    lines.append(f"{role}:".encode("utf-8", "surrogatepass"))
                self._write(digest, before, lines)
                if kept or edits[-1] == "R":
                    digest.update(raw)
            digests[state] = digest
        self.digests = digests

    @staticmethod
    def _write(digest, before: int, lines: list[bytes]) -> None:
        if before:
            digest.update(b"\n")
        digest.update(b"\n".join(lines))

    def report(self) -> tuple:
        layers, order = self.config
        best = None
        for place, q in enumerate(order):
            for edits, roles, state in _insertions(q):
                if ACCEPTING >> state & 1:
                    key = (_least(layers, q) + INSERT * len(edits), place, edits)
                    if best is None or key < best[0]:
                        best = (key, q, edits, roles)
        (cost, _, _), q, edits, roles = best
        digest = self.digests[q].copy()
        if roles:
            self._write(digest, q, [f"{ROLES[r]}:".encode() for r in roles])
        audit = [edits]
        for id in reversed(self.trace):
            move = next(m for m in self.steps.made[id][3] if m[0] == q)
            audit.append(move[2])
            q = move[1]
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.id, gaps, *self.faults[1:], self.illegal, self.cost + cost, "".join(reversed(audit)), digest.hexdigest()


# ---------------------------------------------------------------- rows


def damage(rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): the rows with faults planted by the checksum of `id:turn` modulo 20: 0 drops a row (it
    stays as a marker), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user. Nulls but those of id and
    turn become one space, and in the checksum these do too."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(id), F.lit(":"), shown(turn)).cast("binary")) % 20
    out = rows.select(F.col(id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), kind.alias("_kind"))
    out = out.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text_ = F.when(F.col("_kind") < 2, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return out.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text_.alias("text"), (F.col("_kind") == 0).alias("dropped"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def faults(rows: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text, dropped), dealt by conversation, with the fault that each has first: blank, duplicate of
    an earlier row's role and text, truncated, or none."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(bare == "", BLANK).when(again, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    return rows.repartition(partitions(rows.sparkSession), "conv_id").withColumn("fault", fault)


def repair(rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows are in order of turn, null first; rows of one turn follow by role and text. A null role or text is one space. Rows with a
    null id are one conversation. Edits: keep, rerole to user or assistant, delete (what blank rows and duplicates need), insert a
    row without text; the audit holds their initials, of equal costs the first in ASCII order. Other roles than those that begin
    with s, u or a, the empty one too, can't be kept and make their neighbourhoods illegal. Rows where `dropped` is true count for
    nothing but that their conversation is reported; without rows it has zeros, no audit, and the digest of nothing. An empty
    table gives an empty one; other columns do not matter.

    A conversation's rows stream through one task, as the digest of its repaired text asks for; sorting spills, nothing is collected.
    """
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(F.col(id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), F.when(gone, F.lit("")).otherwise(filled(text)).alias("text"), gone.alias("dropped"))
    given = faults(given).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order(), F.col("fault") == DUPLICATE)  # the first of equal rows first
    given = given.select("conv_id", "turn", "role", "text", "fault", "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, now, done = Steps(), None, []

        def table(found: list[tuple]) -> pa.RecordBatch:
            types = [batch_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [c.split()[0] for c in REPORT.split(", ")])

        batch_type = None
        for batch in batches:
            batch_type = batch.column(0).type
            for conv, turn_, role_, text_, fault, dropped_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.id:
                    if now is not None:
                        done.append(now.report())
                        if len(done) >= 4096:
                            yield table(done)
                            done = []
                    now = Conversation(steps, conv)
                if not dropped_:
                    now.add(turn_, role_, text_, fault)
        if now is not None:
            yield table([*done, now.report()])

    return given.mapInArrow(run, REPORT.replace("conv_id string", f"conv_id {given.schema['conv_id'].dataType.simpleString()}", 1))


def repaired(rows: DataFrame, report: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, nth, edit, role, text): the repaired conversations, from repair()'s report of the same rows. Joins and windows by
    conversation; nth counts from 0."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(F.col(id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    given = given.withColumn("row", F.row_number().over(Window.partitionBy("conv_id").orderBy(*_order()))).drop("turn")
    edits = report.where("audit <> ''").select(F.col("conv_id").alias("_conv"), F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    whole = Window.partitionBy("_conv")
    upto = whole.orderBy("at")
    edits = edits.withColumn("_row", F.sum((F.col("edit") != "I").cast("int")).over(upto)).withColumn("nth", F.sum((F.col("edit") != "D").cast("int")).over(upto) - 1)
    edits = edits.withColumn("_odd", F.sum((F.col("edit") != "D").cast("int")).over(whole) % 2).where("edit <> 'D'")
    found = edits.join(given, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_row") == F.col("row")) & (F.col("edit") != "I"), "left")
    written = F.when((F.col("nth") + F.col("_odd")) % 2 == 0, "user").otherwise("assistant")
    return found.select(F.col("_conv").alias("conv_id"), F.col("nth").cast("long").alias("nth"), "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(written).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
