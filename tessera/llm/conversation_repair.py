"""Conversation structure repair: the cheapest edits that make a conversation's roles well formed.

A conversation's rows and four role states make a lattice with integer arc costs.  The auction algorithm finds a
shortest path: prices start as a feasible lower bound, a path grows from the origin along an arc that its last node's
price equals, and shrinks by a node whose price had to be raised to the least of its arcs.  When the path ends, prices
are dual to it: an arc is on some shortest path only if it is tight (its cost is the difference of its
ends' prices).  The edits come from the tight arcs, at each node the least letter that still leads to the end.

One shuffle brings a conversation's rows together in order, each twice: first without texts (one byte a row is
kept of these), then, when the edits are known, with texts, which are only passed on.  So a task holds one
byte a row of one conversation, as many as its audit has letters, and never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant.  A conversation may end in the first or the last.
ENDS = (0, None, None, 0)
#: The state that a user or assistant turn leads to; which of the two it is follows from the state.
NEXT = (2, 2, 3, 2)
#: Fault codes of a row; its byte in a shape is 4 * fault + role (system, user, assistant, another).
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAULTS = ("", "blank", "duplicate", "truncated")
#: Rows of a lattice that is solved at once; longer conversations are solved from block to block.
BLOCK = 256
WHITE = " \t\n\x0b\x0c\r"


def _arcs(shape: bytes, layer: int, state: int, inserts: bool) -> list[tuple[str, int, int, int]]:
    """Arcs (letter, layer, state, cost) out of a node, by letter."""
    found = []
    if layer < len(shape):
        fault, role = divmod(shape[layer], 4)
        found.append(("D", layer + 1, state, DELETE))
        if inserts:
            found.append(("I", layer, NEXT[state], INSERT))
        if fault not in (BLANK, DUPLICATE):
            extra = BROKEN if fault == TRUNCATED else 0
            if role == 0 and state == 0:
                found.append(("K", layer + 1, 1, KEEP + extra))
            elif role == (2 if state == 2 else 1):
                found.append(("K", layer + 1, NEXT[state], KEEP + extra))
            found.append(("R", layer + 1, NEXT[state], REROLE + extra))
    elif inserts:
        found.append(("I", layer, NEXT[state], INSERT))
    return found


class Lattice:
    """A block of rows and what it costs to go on from each state behind it (None: no way).

    Only the last block has inserts behind its last row; those of others belong to the next block.
    """

    def __init__(self, shape: bytes, ends, last: bool):
        self.shape, self.ends, self.last = shape, ends, last
        self.sink = 4 * (len(shape) + 1)
        self.arcs: dict[int, list[tuple[str, int, int]]] = {}
        # A feasible start: every faulty row costs 2 at least, and behind the block the least of its ends.
        self.prices = [0] * (self.sink + 1)
        after = min(e for e in ends if e is not None)
        for layer in range(len(shape), -1, -1):
            if layer < len(shape) and shape[layer] >= 4:
                after += DELETE
            self.prices[4 * layer : 4 * layer + 4] = [after] * 4

    def out(self, node: int) -> list[tuple[str, int, int]]:
        """Arcs (letter, node, cost) of a node; that to the sink has no letter."""
        found = self.arcs.get(node)
        if found is None:
            layer, state = divmod(node, 4)
            found = [(letter, 4 * i + s, cost) for letter, i, s, cost in _arcs(self.shape, layer, state, self.last or layer < len(self.shape))]
            if layer == len(self.shape) and self.ends[state] is not None:
                found.insert(0, ("", self.sink, self.ends[state]))
            self.arcs[node] = found
        return found

    def auction(self, state: int) -> int:
        """The cost from a state before the first row to the end; leaves dual prices behind."""
        prices, path = self.prices, [state]
        while path[-1] != self.sink:
            node = path[-1]
            least, best = min((cost + prices[to], to) for _, to, cost in self.out(node))
            if prices[node] < least:
                prices[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best)
        return prices[state] - prices[self.sink]

    def trace(self, state: int) -> tuple[str, int]:
        """The least letters over tight arcs from a state to the end, and the state behind the last row."""
        prices, leads = self.prices, [False] * self.sink + [True]

        def tight(node: int):
            return ((letter, to) for letter, to, cost in self.out(node) if prices[node] == cost + prices[to])

        for layer in range(len(self.shape), -1, -1):
            for _ in range(4):  # inserts lead from state to state of a layer
                for node in range(4 * layer, 4 * layer + 4):
                    leads[node] = leads[node] or any(leads[to] for _, to in tight(node))
        letters, node = [], state
        while True:
            letter, to = min((letter, to) for letter, to in tight(node) if leads[to])
            if to == self.sink:
                return "".join(letters), node % 4
            letters.append(letter)
            node = to


def cheapest_edits(shape: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a conversation (D, I, K, R in order; the least of equals).

    Blocks are priced from the last to the first: the cost of each state before a block is its end's cost for the
    block ahead of it.  Then they are traced from the first to the last.
    """
    starts = range(0, max(len(shape), 1), block)
    ends = [ENDS]
    for at in reversed(starts[1:]):
        lattice = Lattice(shape[at : at + block], ends[-1], len(ends) == 1)
        ends.append(tuple(lattice.auction(s) for s in range(4)))
    letters, state, cost = [], 0, 0
    for k, at in enumerate(starts):
        lattice = Lattice(shape[at : at + block], ends[-1 - k], k == len(starts) - 1)
        price = lattice.auction(state)
        cost = cost if k else price
        some, state = lattice.trace(state)
        letters.append(some)
    return cost, "".join(letters)


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; null role and text: one space) with ``key``, a digest of role and text, and whether they are blank or truncated."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    return rows.withColumns({"key": key, "blank": last == "", "broken": ~last.isin(".", "!", "?")})


def _role_code(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


EDITS = "conv_id {id}, step long, edit string, turn long, role_before string, role string, text string, fault string, cost long"


def repair(rows: DataFrame) -> DataFrame:
    """Every edit of every conversation, in order: (conv_id, step, edit, turn, role_before, role, text, fault, cost).

    ``edit`` is K, R, D or I; the repaired conversation is the rows that aren't D, with ``role`` and ``text``.
    ``rows`` has conv_id, turn, role and text; other columns are left out.  Conversations are ordered by turn, null
    turns first; rows of one turn by role and a digest of role and text.  Null roles and texts are one space, so a
    null text is blank; a null conv_id is a conversation of its own.  Conversations come out whole and in order within
    one partition.  No rows: no rows.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    twice = with_faults(rows).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("text", F.when(F.col("pass") == 1, F.col("text")))
    seen = F.row_number().over(Window.partitionBy("conv_id", "pass", "key").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("blank"), BLANK).when(F.col("seen") > 1, DUPLICATE).when(F.col("broken"), TRUNCATED).otherwise(FINE)
    placed = twice.repartition("conv_id").withColumn("seen", seen).withColumn("shape", 4 * fault + _role_code(F.col("role")))
    ordered = placed.sortWithinPartitions("conv_id", "pass", *order, "seen").select("conv_id", "pass", "turn", "role", "text", "shape")
    schema = EDITS.format(id=dict(rows.dtypes)["conv_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, str]] = {}
        shape, current, letters, at, step, state, begun = bytearray(), None, "", 0, 0, 0, False
        out: list[tuple] = []

        def inserted(conv) -> None:
            nonlocal at, step, state
            while at < len(letters) and letters[at] == "I":
                out.append((conv, step, "I", None, None, "assistant" if state == 2 else "user", "", "", INSERT))
                state, at, step = NEXT[state], at + 1, step + 1

        def flush(id_type) -> pa.RecordBatch:
            kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            names = ["conv_id", "step", "edit", "turn", "role_before", "role", "text", "fault", "cost"]
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
            out.clear()
            return made

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            held = 0
            for conv, second, turn, role, text, code in zip(*(c.to_pylist() for c in batch.columns)):
                if not second:
                    if begun or not shape:
                        if begun:
                            inserted(current)
                        shape, current, begun = bytearray(), conv, False
                    shape.append(code)
                    if out and (held > 1 << 22 or len(out) > 10_000):
                        yield flush(id_type)
                        held = 0
                    continue
                if not begun:
                    begun, at, step, state = True, 0, 0, 0
                    found = known.get(bytes(shape))
                    if found is None:
                        found = cheapest_edits(bytes(shape))
                        if len(shape) <= 64 and len(known) < 100_000:
                            known[bytes(shape)] = found
                    letters = found[1]
                inserted(conv)
                fault, kind = divmod(code, 4)
                edit = letters[at]
                cost = {"K": KEEP, "R": REROLE, "D": DELETE}[edit] + (BROKEN if fault == TRUNCATED and edit != "D" else 0)
                now = "assistant" if state == 2 else "user"
                out.append((conv, step, edit, turn, role, role if edit != "R" else now, text, FAULTS[fault], cost))
                if edit != "D":
                    state = 1 if edit == "K" and kind == 0 else NEXT[state]
                at, step, held = at + 1, step + 1, held + len(text)
                if held > 1 << 22 or len(out) > 10_000:
                    yield flush(id_type)
                    held = 0
        if begun:
            inserted(current)
        if out:
            yield flush(id_type)

    return ordered.mapInArrow(run, schema)


def summaries(edits: DataFrame) -> DataFrame:
    """One row a conversation of ``repair``'s rows, which must come as it left them: counts, cost, audit and the SHA-256 of what was repaired.

    ``gaps`` are turn numbers that are missing between the least and the greatest; ``illegal`` counts neighbours whose
    roles' initials aren't su, ua or au, before the repair.
    """
    kind = dict(edits.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, fresh, id_type = [], None, True, None

        def close() -> None:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            done.append((conv, gaps, *(faults[f] for f in FAULTS[1:]), illegal, cost, b"".join(audit).decode(), digest.hexdigest()))

        def flush() -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], schema_names)
            done.clear()
            return made

        schema_names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        for batch in batches:
            id_type = batch.column(0).type
            for new, step, edit, turn, before, role, text, fault, price in zip(*(c.to_pylist() for c in batch.columns)):
                if step == 0:
                    if not fresh:
                        close()
                    conv, fresh = new, False
                    turns, faults, illegal, cost, audit, digest, previous, any_row = [], dict.fromkeys(FAULTS, 0), 0, 0, [], hashlib.sha256(), None, False
                audit.append(edit.encode())
                if len(audit) > 4096:
                    audit = [b"".join(audit)]
                cost += price
                if edit != "I":
                    if turn is not None:
                        turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
                    faults[fault] += 1
                    if previous is not None and previous + before[:1] not in ("su", "ua", "au"):
                        illegal += 1
                    previous = before[:1]
                if edit != "D":
                    digest.update((("\n" if any_row else "") + f"{role}:{text}").encode())
                    any_row = True
            if len(done) > 5_000:
                yield flush()
        if not fresh:
            close()
        if done:
            yield flush()

    return edits.mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties, 2 takes [.!?] out, 3 repeats, 4 makes a user's.  Nulls are one space in the key, role and text."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    made = rows.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("__times"),
    )
    return made.withColumn("__copy", F.explode(F.expr("array_repeat(1, __times)"))).drop("__times", "__copy")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """The damage done to every conversation and its cheapest repair; conversations that lost all rows have zeros and empty texts."""
    found = summaries(repair(damage(rows)))
    ids = rows.select("conv_id").distinct().withColumnRenamed("conv_id", "__id")
    joined = ids.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(F.col("__id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
