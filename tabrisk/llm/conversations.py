"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation is read as the initials of its roles.  The repaired sequence of
initials must match ``(s?(ua)+)?``, and the cheapest edits that reach it are
looked for: Keep (0), Rerole to user or assistant (2), Delete (3, the only edit
of blank and duplicate turns), Insert an empty user or assistant turn (2); a
truncated turn that is not deleted adds 1.  A node of the lattice is (turns
consumed, state of the pattern), an edge is one edit.  A forward heap from the
start and a reverse heap from the accepting ends finish one distance after the
other, always the nearer side, until their radii cover the best meeting found.
Both then know the least edit string of every node they have finished, and
the least concatenation over *all* crossings of that cost is the audit.

No edit string is built before the end: a node holds its parent and one label.
From one node every label leads to one successor, and of two equally cheap
prefixes of one node none is a prefix of the other (what follows could only be
insertions, which cost), so two strings are compared at the node where their
paths part.

On Spark, damage, faults and digests are columns.  Rows are dealt by
conversation and sorted, and two streaming passes go through them: the first
reads role, faults and digest of a turn (no text) and returns the audit, the
second replays the audit over the texts.  Neither holds a text for longer than
its turn; a conversation in work takes some hundred bytes for each turn, and
what its result needs (one audit letter a turn, one digest of all its text in
order) makes it the unit of work.

Defined results: NULL role and text count as one space, a NULL conversation is
one conversation, NULL turns come first; rows of one turn are ordered by role
and then by a digest of role and text, so repeated rows stay adjacent; a role
that does not begin with s, u or a can't be kept; the empty role has no initial
and makes its two neighbourhoods illegal; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.shared import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1   # costs
ROLES = {"u": "user", "a": "assistant"}

# states of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = ("u", "u", "a", "u")                     # role that may follow, by state
THEN = {"u": AFTER_U, "a": AFTER_A}
BEFORE = {AFTER_U: (START, AFTER_S, AFTER_A), AFTER_A: (AFTER_U,)}

# faults of a turn
CLEAN, BLANK, DUPLICATE, CUT_OFF = range(4)


# ---- the lattice --------------------------------------------------------------

class Lattice:
    """Edit lattice of turns given as (initial, fault); nodes are 4 * i + state."""

    def __init__(self, initials: str | list[str], faults: list[int]):
        self.initials, self.faults, self.n = initials, faults, len(faults)

    def _take(self, i: int, state: int):
        """(label, state after, cost) of the edits that leave turn i in."""
        fault = self.faults[i]
        if fault in (BLANK, DUPLICATE):
            return
        extra = TRUNCATED if fault == CUT_OFF else 0
        role, initial = NEXT[state], self.initials[i]
        if initial == role:
            yield "K", THEN[role], KEEP + extra
        elif initial == "s" and state == START:
            yield "K", AFTER_S, KEEP + extra
        yield "R", THEN[role], REROLE + extra

    def ahead(self, node: int):
        """(label, successor, cost) of every edit from a node."""
        i, state = divmod(node, 4)
        yield "I", 4 * i + THEN[NEXT[state]], INSERT
        if i < self.n:
            yield "D", node + 4, DELETE
            for label, after, cost in self._take(i, state):
                yield label, 4 * (i + 1) + after, cost

    def back(self, node: int):
        """(label, predecessor, cost) of every edit into a node."""
        i, state = divmod(node, 4)
        for before in BEFORE.get(state, ()):
            yield "I", 4 * i + before, INSERT
        if i:
            yield "D", node - 4, DELETE
            for before in (START,) if state == AFTER_S else BEFORE.get(state, ()):
                for label, after, cost in self._take(i - 1, before):
                    if after == state:
                        yield label, 4 * (i - 1) + before, cost

    def solve(self) -> tuple[int, str]:
        """(least cost, least audit of that cost)."""
        ends = {4 * self.n + START, 4 * self.n + AFTER_A}
        ahead, back = {START: 0}, dict.fromkeys(ends, 0)      # best distances so far
        parent, depth = {}, {START: 0}                        # node -> (node before, label)
        follow = {}                                           # node -> (label, node after)
        # among equal distances free edits go from turn to turn: early turns first, from behind late ones first
        heap_a, heap_b = [(0, START)], [(0, -e) for e in ends]
        done_a, done_b = set(), set()
        radius_a = radius_b = -1
        best = min((0 for e in ends if e in ahead), default=float("inf"))

        def before(a, label_a, b, label_b) -> bool:
            """Whether path a + label_a is less than b + label_b."""
            while a != b:
                if depth[a] >= depth[b]:
                    a, label_a = parent[a]
                else:
                    b, label_b = parent[b]
            return label_a < label_b

        while radius_a + radius_b < best and (heap_a or heap_b):
            if heap_a and (not heap_b or heap_a[0][0] <= heap_b[0][0]):
                radius_a = heap_a[0][0]
                while heap_a and heap_a[0][0] == radius_a:
                    node = heappop(heap_a)[1]
                    if node in done_a or ahead[node] < radius_a:
                        continue
                    done_a.add(node)
                    if node != START:
                        depth[node] = depth[parent[node][0]] + 1
                    for label, to, cost in self.ahead(node):
                        far = radius_a + cost
                        old = ahead.get(to)
                        if old is None or far < old:
                            ahead[to], parent[to] = far, (node, label)
                            heappush(heap_a, (far, to))
                        elif far == old and to not in done_a and before(node, label, *parent[to]):
                            parent[to] = node, label
                        if to in back:
                            best = min(best, far + back[to])
            else:
                radius_b = heap_b[0][0]
                while heap_b and heap_b[0][0] == radius_b:
                    node = -heappop(heap_b)[1]
                    if node in done_b or back[node] < radius_b:
                        continue
                    done_b.add(node)
                    for label, come, cost in self.back(node):
                        far = radius_b + cost
                        old = back.get(come)
                        if old is None or far < old:
                            back[come], follow[come] = far, (label, node)
                            heappush(heap_b, (far, -come))
                        elif far == old and come not in done_b and label < follow[come][0]:
                            follow[come] = label, node
                        if come in ahead:
                            best = min(best, far + ahead[come])

        least = None                                          # (node, label, node after or None)
        for node in done_a:
            crossings = [(label, to) for label, to, cost in self.ahead(node)
                         if ahead[node] + cost > radius_a and to in done_b and ahead[node] + cost + back[to] == best]
            if node in ends and ahead[node] == best:
                crossings.append(("", None))
            for label, to in crossings:
                if least is None or before(node, label, least[0], least[1]):
                    least = node, label, to
        node, label, to = least
        first = []
        while node != START:
            node, step = parent[node]
            first.append(step)
        last = [label]
        while to is not None and to not in ends:
            step, to = follow[to]
            last.append(step)
        return best, "".join(reversed(first)) + "".join(last)


def replay(initials, audit: str):
    """(turn or None, role or None) of every turn that an audit leaves: the turn's
    number, None for an inserted one; the new role, None for a kept one."""
    state, i = START, 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        keep = edit == "K"
        role = NEXT[state]
        yield (None if edit == "I" else i), (None if keep else ROLES[role])
        state = AFTER_S if keep and initials[i] == "s" else THEN[role]
        i += edit != "I"


# ---- damage -------------------------------------------------------------------

def damage(convs: DataFrame) -> DataFrame:
    """The damaged rows, drawn by ``crc32('conv_id:turn') % 20``: 0 drops the row,
    1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes it the user's."""
    said = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = convs.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
                        (F.crc32(said.cast("binary")) % 20).alias("_m")).where("_m <> 0")
    m = F.col("_m")
    text = F.when(m == 1, F.lit("")).when(m == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(m == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.when(m == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


# ---- passes -------------------------------------------------------------------

_ORDER = ["_conv", "_kind", "_turn", "_role", "_digest"]
_PLAN = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
         "cost bigint, audit string")


def _turns(rows: DataFrame) -> DataFrame:
    """Turns with their faults; ``_text`` is read by the second pass only."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    inked = r"[^\x20\x09-\x0D]"
    return rows.select(
        F.col("conv_id").cast("bigint").alias("_conv"), F.lit(1).alias("_kind"), F.col("turn").cast("bigint").alias("_turn"),
        role.alias("_role"), F.unhex(F.md5(F.concat_ws("\0", role, text).cast("binary"))).alias("_digest"), text.alias("_text"),
        (~text.rlike(inked)).alias("_blank"),
        (text.rlike(inked) & ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("_cut"))


def _dealt(turns: DataFrame) -> DataFrame:
    return turns.repartition("_conv").sortWithinPartitions(*_ORDER)  # NULL turns first


def _plan(batches):
    """Audits of the conversations of one partition, from sorted turns."""
    held: dict = {}

    def ended():
        legal, initials, turns = ("su", "ua", "au"), held["initials"], held["turns"]
        cost, audit = Lattice(initials, held["faults"]).solve()
        counts = [held["faults"].count(f) for f in (BLANK, DUPLICATE, CUT_OFF)]
        illegal = sum(a + b not in legal for a, b in zip(initials, initials[1:]))
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return held["conv"], gaps, *counts, illegal, cost, audit

    def rows():
        for batch in batches:
            for conv, turn, role, digest, blank, cut_off in zip(*(batch.column(c).to_pylist() for c in (
                    "_conv", "_turn", "_role", "_digest", "_blank", "_cut"))):
                if not held or held["conv"] != conv:
                    if held:
                        yield ended()
                    held.update(conv=conv, initials=[], faults=[], seen=set(), turns=None)
                held["initials"].append(role[:1])
                held["faults"].append(BLANK if blank else DUPLICATE if digest in held["seen"] else CUT_OFF if cut_off else CLEAN)
                held["seen"].add(digest)
                if turn is not None:  # least, greatest, distinct: turns come in order
                    low, high, many = held["turns"] or (turn, None, 0)
                    held["turns"] = low, turn, many + (turn != high)
        if held:
            yield ended()

    yield from _batches(rows(), pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64())
                                           for c in _PLAN.split(", ")]))


def _batches(rows, schema: pa.Schema, most: int = 4 << 20):
    """Rows in record batches of about ``most`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 40 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)


def repair_plan(rows: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id``, counts of what is wrong, least ``cost`` and ``audit``."""
    return _dealt(_turns(rows).drop("_text")).mapInArrow(_plan, _PLAN)


def _with_audits(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Sorted turns, each conversation's audit before its first turn."""
    audits = plan.select(F.col("conv_id").alias("_conv"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_turn"),
                         F.lit("").alias("_role"), F.lit(None).cast("binary").alias("_digest"), F.col("audit").alias("_text"))
    return _dealt(audits.union(_turns(rows).select(*audits.columns))).select("_conv", "_kind", "_turn", "_role", "_text")


def _replayed(batches):
    """(conversation, new?, edit, turn, role, text) of what audits leave, in order;
    ``new?`` marks a conversation's begin and carries no turn."""
    conv, edits, at, state = None, "", 0, START
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_conv", "_kind", "_turn", "_role", "_text"))))

    def inserts():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            role = NEXT[state]
            state, at = THEN[role], at + 1
            yield conv, False, "I", None, ROLES[role], ""

    for key, kind, turn, role, text in rows:
        if kind == 0:
            yield from inserts()
            conv, edits, at, state = key, text, 0, START
            yield conv, True, "", None, "", ""
            continue
        yield from inserts()
        edit, at = edits[at], at + 1
        if edit == "D":
            continue
        new = NEXT[state]
        if edit == "K":
            state = AFTER_S if role[:1] == "s" else THEN[new]
            yield conv, False, "K", turn, role, text
        else:
            state = THEN[new]
            yield conv, False, "R", turn, ROLES[new], text
    yield from inserts()


def _repaired(batches):
    def rows():
        place = 0
        for conv, new, edit, turn, role, text in _replayed(batches):
            place = 0 if new else place + 1
            if not new:
                yield conv, place - 1, edit, turn, role, text

    yield from _batches(rows(), pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()),
                                           ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def _hashed(batches):
    def rows():
        conv = hasher = None
        place = 0
        for key, new, _, _, role, text in _replayed(batches):
            if new:
                if hasher:
                    yield conv, hasher.hexdigest()
                conv, hasher, place = key, hashlib.sha256(), 0
                continue
            if place:
                hasher.update(b"\n")
            hasher.update(role.encode() + b":")
            hasher.update(text.encode())
            place += 1
        if hasher:
            yield conv, hasher.hexdigest()

    yield from _batches(rows(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, place, edit, turn, role, text``; edit is K, R
    or I, and ``turn`` is NULL for inserted ones."""
    return _with_audits(rows, cut(repair_plan(rows))).mapInArrow(
        _repaired, "conv_id bigint, place bigint, edit string, turn bigint, role string, text string")


def repair_digest(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """:func:`repair_plan` with the SHA-256 of each repaired conversation's
    ``role:text`` lines.  With ``conversations`` one row for each of its ``conv_id``;
    those without rows have zeros, no edits and the empty text's digest."""
    plan = cut(repair_plan(rows))
    lines = _with_audits(rows, plan).mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string")
    out = plan.alias("p").join(lines.alias("l"), F.col("p.conv_id").eqNullSafe(F.col("l.conv_id"))).select(
        "p.*", "l.repaired_sha256")
    if conversations is None:
        return out
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("_id")).distinct()
    out = ids.join(out, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return out.select(F.col("_id").alias("conv_id"), *[
        F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("bigint"))).alias(c) for c in out.columns[2:]])
