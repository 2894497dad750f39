"""Repair of conversations: the cheapest edits that make turns alternate, found by A* on the lattice of rows and roles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ordering import with_position
from .scratch import written
from .text import SPACE

#: Rows of a piece: a longer conversation is searched in pieces.
PIECE = 1024
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
#: What a truncated row costs unless it is deleted.
TRUNCATED = 5
#: Where a conversation stands: at its start, after a system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Initials as numbers; any other role is 3.
INITIALS = "sua"
#: By state: the states that keeping a row with each initial leads to, and the one after a user's or assistant's row that is put there.
_KEPT = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
_PUT = (USER, USER, ASSISTANT, USER)
_PUT_ROLE = ("", "", "user", "assistant")
_LEGAL = {(0, 1), (1, 2), (2, 1)}
#: A row as a number: its initial, whether it must go (blank or a duplicate), whether it is truncated.
MUST_GO, CUT = 4, 8

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PLAN = "conv_id long, " + "".join(f"{c} long, " for c in _COUNTS) + "audit string"
_PIECE = "conv_id long, piece long, initials array<int>, turns array<long>, counts array<long>, costs array<long>, audits array<string>"


def cheapest_edits(rows: list[int], start: int = START, goals: Iterable[int] = (START, ASSISTANT), every: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest edits of ``rows`` that end in one of ``goals``, with ``every`` of those that end in each of them that can be reached.

    A node of the lattice is a number of rows done and a state; each edit is an edge. A* takes the node with the least cost so far plus what the rows ahead
    cost in any case: 2 for each row that must go, and 2 for each truncated one, as deleting it is cheaper than keeping it. Of equal sums the least audit goes first. No circle of edits is free, so no audit of
    a node is the beginning of an equally cheap one, and the first that reaches a node is the best.
    """
    ahead = [0] * (len(rows) + 1)
    for k in range(len(rows) - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if rows[k] & (MUST_GO | CUT) else 0)
    queue = [(ahead[0], "", 0, start)]
    wanted, done = set(goals), set()
    out: dict[int, tuple[int, str]] = {}
    while queue:
        total, audit, at, state = heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in wanted:
            out[state] = (total, audit)
            if not every or len(out) == len(wanted):
                break
        put = _PUT[state]
        if (at, put) not in done:
            heappush(queue, (total + INSERT, audit + "I", at, put))
        if at < len(rows):
            row, rest = rows[at], total - ahead[at] + ahead[at + 1]
            if (at + 1, state) not in done:
                heappush(queue, (rest + DELETE, audit + "D", at + 1, state))
            if not row & MUST_GO:
                stays = rest + (TRUNCATED if row & CUT else 0)
                kept = _KEPT[state].get(row & 3)
                if kept is not None and (at + 1, kept) not in done:
                    heappush(queue, (stays + KEEP, audit + "K", at + 1, kept))
                if (at + 1, put) not in done:
                    heappush(queue, (stays + REROLE, audit + "R", at + 1, put))
    return out


class _Path:
    """An audit as the last of its parts and the path before: paths that part and meet share what they have in common."""

    __slots__ = ("before", "part", "cost")

    def __init__(self, before: _Path | None, part: str, cost: int):
        self.before, self.part, self.cost = before, part, cost

    def less(self, other: _Path) -> bool:
        """Whether this audit of as many parts is less."""
        a, b, mine, others = self, other, [], []
        while a is not b:
            mine.append(a.part)
            others.append(b.part)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(others))

    def text(self) -> str:
        parts, at = [], self
        while at is not None:
            parts.append(at.part)
            at = at.before
        return "".join(reversed(parts))


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``size`` rows or some 4 million characters."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _long(*names: str) -> list[pa.Field]:
    return [pa.field(n, pa.int64()) for n in names]


_PIECES = pa.schema([*_long("conv_id", "piece"), pa.field("initials", pa.list_(pa.int32())), *(pa.field(n, pa.list_(pa.int64())) for n in ("turns", "counts", "costs")), pa.field("audits", pa.list_(pa.string()))])
_PLANS = pa.schema([*_long("conv_id", *_COUNTS), pa.field("audit", pa.string())])


def sound_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` only; a null role or text is one space."""
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _order() -> list[Column]:
    """Order of a conversation's rows: by turn, null first; rows of one turn by role, then by a digest of the text, so that only equal rows are interchangeable."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def marked_rows(turns: DataFrame) -> DataFrame:
    """Position of each row over all conversations, and its first fault: ``conv_id``, ``turn``, ``position``, ``initial``, ``blank``, ``duplicate``, ``truncated``. Texts stay behind."""
    initial = F.position(F.left("role", F.lit(1)), F.lit(INITIALS)) - 1
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    light = sound_turns(turns).select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), F.when((F.col("role") != "") & (initial >= 0), initial).otherwise(F.lit(3)).alias("initial"),
        (end == "").alias("blank"), ((end != "") & ~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("row"),
    )
    # the row's number tells equal rows apart, so that however many there are they spread over partitions
    placed = with_position(light, [F.col("conv_id").asc_nulls_first(), *_order(), F.col("row")]).drop("row")
    firsts = placed.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("_first"))
    seen = placed.join(firsts, "position", "left").withColumn("duplicate", ~F.col("blank") & F.col("_first").isNull())
    return seen.select("conv_id", "turn", "position", "initial", "blank", "duplicate", (F.col("cut") & ~F.col("duplicate")).alias("truncated"))


def _searched(piece_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each piece of a conversation: what the next step needs to join pieces, and the cheapest edits from each state to each other.

    A piece that holds neither the first nor the last position of its stretch is a whole conversation, which starts at the start.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, piece), found in groupby(_tuples(batches), itemgetter(0, 1)):
            codes, turns, counts, edge, last = [], [], [0, 0, 0, 0], False, None
            for _, _, position, turn, initial, blank, duplicate, truncated in found:
                codes.append(initial | (MUST_GO if blank or duplicate else 0) | (CUT if truncated else 0))
                counts[0] += blank
                counts[1] += duplicate
                counts[2] += truncated
                counts[3] += last is not None and (last, initial) not in _LEGAL
                last = initial
                edge = edge or position % piece_rows in (0, piece_rows - 1)
                if turn is not None:
                    if not turns:
                        turns = [turn, turn, 1]
                    elif turn != turns[1]:
                        turns[1:] = [turn, turns[2] + 1]
            costs, audits = [None] * 16, [None] * 16
            for start in range(4) if edge else (START,):
                for goal, (cost, audit) in cheapest_edits(codes, start, range(4) if edge else (START, ASSISTANT), every=edge).items():
                    costs[4 * start + goal], audits[4 * start + goal] = cost, audit
            yield conv, piece, [codes[0] & 3, codes[-1] & 3], turns, counts, costs, audits

    return lambda batches: _batches(rows(batches), _PIECES, 100)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation from its pieces in order. Of a conversation only the paths that are still open are kept."""

    def rows() -> Iterator[tuple]:
        for conv, pieces in groupby(_tuples(batches), itemgetter(0)):
            paths: dict[int, _Path] = {START: _Path(None, "", 0)}
            total, turns, last = [0, 0, 0, 0], [], None
            for _, _, initials, own, counts, costs, audits in pieces:
                if not initials:  # the row that tells that the conversation exists
                    continue
                total = [a + b for a, b in zip(total, counts, strict=True)]
                total[3] += last is not None and (last, initials[0]) not in _LEGAL
                last = initials[1]
                if own:
                    turns = [turns[0], own[1], turns[2] + own[2] - (own[0] == turns[1])] if turns else own
                reached: dict[int, _Path] = {}
                for start, path in paths.items():
                    for goal in range(4):
                        if (cost := costs[4 * start + goal]) is not None:
                            new, old = _Path(path, audits[4 * start + goal], path.cost + cost), reached.get(goal)
                            if old is None or new.cost < old.cost or (new.cost == old.cost and new.less(old)):
                                reached[goal] = new
                paths = reached
            ends = [paths[g] for g in (START, ASSISTANT) if g in paths]
            best = ends[0] if len(ends) == 1 or ends[0].cost < ends[1].cost or (ends[0].cost == ends[1].cost and ends[0].less(ends[1])) else ends[1]
            yield conv, turns[1] - turns[0] + 1 - turns[2] if turns else 0, *total, best.cost, best.text()

    yield from _batches(rows(), _PLANS)


def edit_plans(turns: DataFrame, conversations: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """For each conversation its faults and its cheapest edits: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    Edits make the initials of the roles match ``(s?(ua)+)?``: keep a row (K, costs 0), make it a user's or an assistant's (R, 1), delete it (D, 2; what is done to blank rows and
    to those whose role and text the conversation has had), insert an empty row of a user or an assistant (I, 5); a truncated row (its last character that is not white space is no ``.``, ``!`` or ``?``) that is not deleted costs 5 more.
    Of equally cheap edits those with the least audit in ASCII are taken. ``gaps`` counts missing turns between the first and the last one, ``illegal`` neighbours whose initials are not su, ua or au.

    Only positions, initials and marks move. All rows are numbered in order of conversation and turn; stretches of ``piece`` positions are searched apart, from each state to each
    other where a conversation may go on, and a conversation's pieces are joined in order. So a conversation of any length is searched by many tasks, and edits are the cheapest of all of it.

    Rows of a turn go by role and text, null turns come first and count no gap, null ids are one conversation, a null role or text is one space, an empty role has no initial. ``conversations`` lists ids that
    get a row even if they have no turns: zeros and an empty audit. Other columns are ignored.
    """
    marked = marked_rows(turns).withColumn("piece", F.floor(F.col("position") / piece))
    columns = ("conv_id", "piece", "position", "turn", "initial", "blank", "duplicate", "truncated")
    pieces = marked.select(*columns).repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "position").mapInArrow(_searched(piece), _PIECE)
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast("long")).distinct()
        pieces = pieces.unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("piece"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in _PIECE.split(", ")[2:])]))
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_joined, PLAN)


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) for each edit, role and text null where a row is deleted."""
    state, at = START, 0
    for role, text in rows:
        while audit[at] == "I":
            state, at = _PUT[state], at + 1
            yield "I", _PUT_ROLE[state], ""
        edit, at = audit[at], at + 1
        if edit == "D":
            yield edit, None, None
        else:
            state = _KEPT[state][INITIALS.index(role[0])] if edit == "K" else _PUT[state]
            yield edit, role if edit == "K" else _PUT_ROLE[state], text
    for _ in audit[at:]:
        state = _PUT[state]
        yield "I", _PUT_ROLE[state], ""


def _with_plans(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, within one partition. Texts move once, in a sort that spills."""
    rows = sound_turns(turns).withColumn("digest", F.md5("text"))
    listed = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", *[F.lit(0).cast("long").alias(c) for c in _COUNTS], F.lit(None).cast("string").alias("audit"))
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "digest", "text")], *_COUNTS, "audit")
    return heads.unionByName(listed).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order()).select("conv_id", "kind", "role", "text", *_COUNTS, "audit")


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """What the plans make of the conversations: ``conv_id``, ``place`` (from 0, of the edit), ``edit``, ``role``, ``text``; of a deleted row role and text are null.

    ``turns`` must be the rows that the plans are from, ``plans`` a written table. A conversation is one task's stream and never held.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, found in groupby(_tuples(batches), itemgetter(0)):
            audit = next(found)[-1]
            for place, edit in enumerate(_edited(audit, ((r[2], r[3]) for r in found))):
                yield conv, place, *edit

    schema = pa.schema([*_long("conv_id", "place"), *(pa.field(n, pa.string()) for n in ("edit", "role", "text"))])
    return _with_plans(turns, plans).mapInArrow(lambda batches: _batches(rows(batches), schema), "conv_id long, place long, edit string, role string, text string")


def repaired_digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with ``repaired_sha256``: SHA-256 in hex of the repaired rows as ``role:text``, joined by newlines.

    A digest goes through a conversation from its first row to its last, so that is one task's stream; no conversation is held.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, found in groupby(_tuples(batches), itemgetter(0)):
            _, _, _, _, *plan = next(found)
            digest, between = hashlib.sha256(), b""
            for _, role, text in _edited(plan[-1], ((r[2], r[3]) for r in found)):
                if role is not None:
                    digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    between = b"\n"
            yield conv, *plan, digest.hexdigest()

    schema = _PLANS.append(pa.field("repaired_sha256", pa.string()))
    return _with_plans(turns, plans).mapInArrow(lambda batches: _batches(rows(batches), schema), PLAN + ", repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in, by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    read = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return read.select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def repair_conversations(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``edit_plans`` and ``repaired_digests`` in one: a row for each conversation. An empty table gives no rows."""
    return repaired_digests(turns, written(edit_plans(turns, conversations), "conversation-plans"))
