"""Repair of conversation structure as a lightest derivation (Knuth's generalisation of Dijkstra's algorithm).

The rows of a conversation, by turn (nulls first; rows of one turn by role, then text), are edited until the
initials of their roles read ``(s?(ua)+)?``.  Items are (rows done, state); a state is what the kept
roles read so far: START nothing, SYSTEM an s, USER ends in u, ASSISTANT ends in a.  The deductions are

    (i, q) -> (i + 1, q')   Keep 0 (a truncated row: 3), Rerole 3 (6), Delete 4
    (i, q) -> (i, q')       Insert 3, an empty user or assistant row
    (n, START), (n, ASSISTANT) -> goal

and an item weighs (cost, audit): the audit is the edits' initials in order.  Every deduction adds to the
cost and appends to the audit, so it never makes an item lighter, and audits of one item and
one cost are never prefixes of each other (another Insert costs 3), so appending keeps their order: the
functions are monotone and superior, the first time an item is popped from the agenda it is final, and the
search ends when the goal is popped.

On Spark: equal rows of a turn are counted before they are shuffled, rows are dealt by range over
(conversation, turn, role, text), and each task walks its sorted rows and cuts them into segments of at
most SEGMENT_ROWS rows and SEGMENT_BYTES bytes.  A conversation that is one segment, as nearly all are, is
repaired there.  A longer one, or one that lies in several tasks, has its segments solved for every pair
of entry and exit state; those small tables are chained in order, and the edits chosen go back
to the segments' rows.  So a conversation that holds a third of all rows is solved by many tasks;
chaining sees a row per segment, and only its audit (a byte a row, one value by contract) and the
digest of its text, which no two tasks can share, belong to a single task, which reads it as a stream.

Defined cases: null role and text are one space; a null conversation is a conversation; null turns come
first and count nowhere in gaps; repeated rows are duplicates; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks as C

SEGMENT_ROWS = 256
SEGMENT_BYTES = 4 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A state that costs this much more than another one is never on the best way: from any state the rest
#: can be repaired for at most this much more than from any other.
SLACK = 4 * max(REROLE, DELETE, INSERT)

#: State after a row whose role has this initial.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

SPACES = r"\x20\x09-\x0D"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
SEGMENT_SCHEMA = (
    "conv_id long, part int, seq int, whole boolean, least long, most long, turns long, blank long, duplicate long, "
    "truncated long, illegal long, first_initial string, last_initial string, cost long, audit string, "
    "ways array<struct<q:int,r:int,cost:long,audit:string>>, "
    "rows array<struct<role:string,text:string,forced:boolean,truncated:boolean,times:long>>, "
    "repaired array<struct<role:string,text:string>>")


# --- one sequence of rows --------------------------------------------------------------------------

def deductions(rows: list[tuple], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(added cost, appended audit, rows done, state) from the item (i, state)."""
    for initial in ROLES:
        if state in NEXT[initial]:
            yield INSERT, "I", i, NEXT[initial][state]
    if i == len(rows):
        return
    role, _, forced, truncated, times = rows[i]
    if forced:      # blank rows and duplicates: deleted, all equal ones at once
        yield DELETE * times, "D" * times, i + 1, state
        return
    extra = TRUNCATED if truncated else 0
    if state in NEXT.get(role[:1], ()):
        yield KEEP + extra, "K", i + 1, NEXT[role[:1]][state]
    for initial in ROLES:
        if state in NEXT[initial]:
            yield REROLE + extra, "R", i + 1, NEXT[initial][state]
    yield DELETE, "D", i + 1, state


def lightest(rows: list[tuple], start: int, goal: bool) -> dict[int, tuple[int, str]]:
    """State -> lightest (cost, audit) with which all rows are done, from ``start``; with ``goal``
    the search ends as soon as the goal item is final, and only its state is told."""
    agenda, final, ends = [(0, "", 0, start)], set(), {}
    while agenda and len(ends) < 4:
        cost, audit, i, state = heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(rows):
            if goal and state in (START, ASSISTANT):
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
        for more, letters, j, after in deductions(rows, i, state):
            if (j, after) not in final:
                heappush(agenda, (cost + more, audit + letters, j, after))
    return ends


def apply(rows: list[tuple], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits leave, from ``state`` on."""
    at = done = 0       # row, and how many of its equals are done
    for edit in audit:
        if edit == "I":
            role, text = ROLES["a" if state == USER else "u"], ""
        else:
            role, text, _, _, times = rows[at]
            done += 1
            if done == times:
                at, done = at + 1, 0
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES["a" if state == USER else "u"]
        state = NEXT[role[:1]][state]
        yield role, text


# --- segments --------------------------------------------------------------------------------------

def _faults(group) -> tuple[list[tuple], list[int]]:
    """A group of ``n`` equal rows of a turn as entries (role, text, forced, truncated, times), and what it counts."""
    n = int(group.n)
    if group.blank:
        return [(group.role, group.text, True, False, n)], [n, 0, 0]
    if group.seen:
        return [(group.role, group.text, True, False, n)], [0, n, 0]
    cut = bool(group.cut)
    first = [(group.role, group.text, False, cut, 1)]
    return first + [(group.role, group.text, True, False, n - 1)] * (n > 1), [0, n - 1, int(cut)]


class _Segment:
    """Rows of one conversation in order."""

    def __init__(self, conv, opens: bool):
        self.conv, self.opens = conv, opens     # opens: certainly holds the conversation's first row
        self.rows, self.counts, self.illegal, self.bytes = [], [0, 0, 0], 0, 0
        self.least = self.most = None
        self.turns, self.first, self.last = 0, None, None

    def add(self, group, turn):
        entries, counts = _faults(group)
        self.rows += entries
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        initial = group.role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += int(group.n) - 1        # equal neighbours
        self.last = initial
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        self.bytes += len(group.role) + len(group.text)

    def full(self) -> bool:
        return len(self.rows) >= SEGMENT_ROWS or self.bytes >= SEGMENT_BYTES

    def out(self, part: int, seq: int, closes: bool) -> dict:
        whole = self.opens and closes
        row = dict(conv_id=self.conv, part=part, seq=seq, whole=whole, least=self.least, most=self.most, turns=self.turns,
                   illegal=self.illegal, first_initial=self.first, last_initial=self.last, cost=None, audit=None,
                   ways=None, rows=None, repaired=None) | dict(zip(COUNTS, self.counts))
        if whole:
            (row["cost"], row["audit"]), = lightest(self.rows, START, True).values()
            row["repaired"] = [dict(role=r, text=t) for r, t in apply(self.rows, row["audit"], START)]
        else:
            row["ways"] = [dict(q=q, r=r, cost=c, audit=a) for q in range(4) for r, (c, a) in lightest(self.rows, q, False).items()]
            row["rows"] = [dict(role=r, text=t, forced=f, truncated=c, times=n) for r, t, f, c, n in self.rows]
        return row


def _nullable(x):
    return None if pd.isna(x) else int(x)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of a task to segments.  Its first and its last conversation may go on in a neighbour."""
    part, seq, now, first = TaskContext.get().partitionId(), 0, None, True
    for pdf in batches:
        out = []
        for g in pdf.itertuples(index=False):
            conv, turn = _nullable(g.conv_id), _nullable(g.turn)
            if now is None:
                now = _Segment(conv, False)
            elif now.conv != conv:
                out.append(now.out(part, seq, not first))
                now, seq, first = _Segment(conv, True), seq + 1, False
            elif now.full():
                out.append(now.out(part, seq, False))
                now, seq = _Segment(conv, False), seq + 1
            now.add(g, turn)
        if out:
            yield pd.DataFrame(out)
    if now is not None:
        yield pd.DataFrame([now.out(part, seq, False)])


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, blank, seen, cut): equal rows of a turn counted, their first fault told."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), known("role").alias("role"), known("text").alias("text"))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    slim = slim.withColumn("same", same)
    counted = slim.groupBy("conv_id", "turn", "same").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    earliest = (slim.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s"))
                .agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count_if(F.col("turn").isNull()).alias("none"))
                .filter((F.col("least") < F.col("most")) | ((F.col("none") > 0) & F.col("least").isNotNull())))
    told = counted.join(earliest, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    seen = F.col("s").isNotNull() & F.col("turn").isNotNull() & ((F.col("none") > 0) | (F.col("turn") > F.col("least")))
    return told.select("conv_id", "turn", "role", "text", "n", (~F.col("text").rlike(f"[^{SPACES}]")).alias("blank"),
                       seen.alias("seen"), (~F.col("text").rlike(f"[.!?][{SPACES}]*\\z")).alias("cut"))


def segments(rows: DataFrame) -> DataFrame:
    """All conversations of ``rows`` (conv_id, turn, role, text) as segments, written to the shared folder."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    C.small_batches(rows.sparkSession)
    dealt = _ordered(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return C.materialize(dealt.mapInPandas(_cut, SEGMENT_SCHEMA), "segments")


# --- conversations of several segments -------------------------------------------------------------

def _chained(parts: list) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, audit, (entry state, audit) of every segment): the lightest way through the segments' tables."""
    live, shared, back = {START: (0, "")}, [], []       # what all live ways begin with is told once
    for p in parts:
        after, came = {}, {}
        for w in p.ways:
            if w["q"] in live:
                cost, audit = live[w["q"]]
                this = (cost + w["cost"], audit + w["audit"])
                if w["r"] not in after or this < after[w["r"]]:
                    after[w["r"]], came[w["r"]] = this, (w["q"], w["audit"])
        least = min(cost for cost, _ in after.values())
        live = {r: v for r, v in after.items() if v[0] <= least + SLACK}
        common = commonprefix([audit for _, audit in live.values()])
        shared.append(common)
        live = {r: (cost, audit[len(common):]) for r, (cost, audit) in live.items()}
        back.append(came)
    (cost, audit), state = min((live[r], r) for r in (START, ASSISTANT) if r in live)
    ways = []
    for came in reversed(back):
        state, piece = came[state]
        ways.append((state, piece))
    return cost, "".join(shared) + audit, ways[::-1]


CHAIN_SCHEMA = ("conv_id long, part int, seq int, gaps long, blank long, duplicate long, truncated long, illegal long, "
                "cost long, audit string, q int")


def _gaps(least, most, turns) -> int:
    return 0 if least is None else most - least + 1 - turns


def _by_conversation(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """Runs of rows of one conversation, as its rows come sorted."""
    run, conv = [], None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if run and _nullable(row.conv_id) != conv:
                yield run
                run = []
            conv = _nullable(row.conv_id)
            run.append(row)
    if run:
        yield run


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per conversation (part null) and one per segment with its entry state and edits."""
    for run in _by_conversation(batches):
        conv = _nullable(run[0].conv_id)
        cost, audit, ways = _chained(run)
        illegal = sum(int(p.illegal) for p in run) + sum(a.last_initial + b.first_initial not in LEGAL for a, b in zip(run, run[1:]))
        least, most, turns = None, None, 0
        for p in run:
            if _nullable(p.least) is not None:
                turns += int(p.turns) - (most == int(p.least))
                least, most = int(p.least) if least is None else least, int(p.most)
        total = dict(conv_id=conv, part=None, seq=None, gaps=_gaps(least, most, turns), illegal=illegal, cost=cost, audit=audit, q=None)
        total |= {c: sum(int(getattr(p, c)) for p in run) for c in COUNTS[:3]}
        yield pd.DataFrame([total])
        none = dict.fromkeys(["gaps", *COUNTS, "cost"])
        steps = [dict(conv_id=conv, part=int(p.part), seq=int(p.seq), audit=a, q=q) | none for p, (q, a) in zip(run, ways)]
        for i in range(0, len(steps), 4096):
            yield pd.DataFrame(steps[i:i + 4096])


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv, part, seq, [(role, text)]): each segment's edits come just before its rows."""
    edits = None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.rows is None:
                edits = (row.audit, int(row.q))
            else:
                rows = [(r["role"], r["text"], r["forced"], r["truncated"], int(r["times"])) for r in row.rows]
                yield _nullable(row.conv_id), int(row.part), int(row.seq), list(apply(rows, *edits))


def _as_rows(batches):
    for conv, part, seq, left in _merge(batches):
        yield pd.DataFrame([dict(conv_id=conv, part=part, seq=seq, repaired=[dict(role=r, text=t) for r, t in left])])


def _as_digest(batches):
    """SHA-256 of a conversation's ``role:text`` lines, read as a stream."""
    conv, sha, begun, open_ = None, None, False, False
    for c, _, _, left in _merge(batches):
        if not open_ or c != conv:
            if open_:
                yield pd.DataFrame([dict(conv_id=conv, sha=sha.hexdigest())])
            conv, sha, begun, open_ = c, hashlib.sha256(), False, True
        for role, text in left:
            sha.update((b"\n" if begun else b"") + f"{role}:{text}".encode("utf-8", "replace"))
            begun = True
    if open_:
        yield pd.DataFrame([dict(conv_id=conv, sha=sha.hexdigest())])


class Repair:
    """What ``repair`` found: tables over the segments in the shared folder."""

    def __init__(self, segments: DataFrame, chained: DataFrame):
        self.segments, self.chained = segments, chained

    def conversations(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row per conversation that has rows."""
        gaps = F.when(F.col("least").isNull(), F.lit(0)).otherwise(F.col("most") - F.col("least") + 1 - F.col("turns"))
        cols = ["conv_id", "gaps", *COUNTS, "cost", "audit"]
        return (self.segments.filter("whole").withColumn("gaps", gaps.cast("long")).select(cols)
                .unionByName(self.chained.filter("part is null").select(cols)))

    def _steps(self) -> DataFrame:
        """Rows of the segments of chained conversations in order, each after its edits."""
        edits = self.chained.filter("part is not null").select("conv_id", "part", "seq", "audit", "q", F.lit(None).cast(
            self.segments.schema["rows"].dataType).alias("rows"), F.lit(0).alias("kind"))
        rows = self.segments.filter("not whole").select("conv_id", "part", "seq", F.lit(None).cast("string").alias("audit"),
                                                        F.lit(None).cast("int").alias("q"), "rows", F.lit(1).alias("kind"))
        return edits.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "kind")

    def rows(self) -> DataFrame:
        """(conv_id, part, seq, pos, role, text): the repaired rows; (part, seq, pos) is their order."""
        kind = "conv_id long, part int, seq int, repaired array<struct<role:string,text:string>>"
        long = self._steps().mapInPandas(_as_rows, kind)
        every = self.segments.filter("whole").select("conv_id", "part", "seq", "repaired").unionByName(long)
        return every.select("conv_id", "part", "seq", F.posexplode("repaired").alias("pos", "line")).select(
            "conv_id", "part", "seq", "pos", "line.role", "line.text")

    def digests(self) -> DataFrame:
        """(conv_id, sha): SHA-256 of the repaired ``role:text`` lines of every conversation that has rows."""
        lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
        short = self.segments.filter("whole").select("conv_id", F.sha2(lines, 256).alias("sha"))
        return short.unionByName(self._steps().mapInPandas(_as_digest, "conv_id long, sha string"))


def repair(rows: DataFrame) -> Repair:
    """Cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text)."""
    cut = segments(rows)
    few = ["conv_id", "part", "seq", "least", "most", "turns", *COUNTS, "first_initial", "last_initial", "ways"]
    apart = cut.filter("not whole").select(few).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return Repair(cut, C.materialize(apart.mapInPandas(_chain, CHAIN_SCHEMA), "chained"))


# --- the query's damage ----------------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row,
    1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it, 4 makes it the user's."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(known("conv_id"), F.lit(":"), known("turn")), "utf-8")) % 20
    hurt = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text: Column = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role: Column = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_copy")).drop("_copy")
