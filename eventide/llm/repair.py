r"""Repair of conversation structure by lightest derivations.

A repaired conversation is empty, or an optional system turn and then user and assistant turns in alternation: ``(s?(ua)+)?`` in
initials.  A row can be kept, given the other role, or deleted; empty turns can be inserted.  Which edits are cheapest is a
weighted deduction (Knuth's generalisation of shortest paths): items are joined by hyperedges

    at(i, state), row i gives initial x    |-  at(i + 1, state after x)
    at(i, state), an inserted turn x       |-  at(i, state after x)
    at(n, accepting state)                 |-  goal

and the weight of a conclusion is the sum of its antecedents' costs with their edits one after the other.  That function is monotone
and never below an antecedent's weight (cost, edits), so the agenda may finalise the least item each time until the goal is the least.  It is
monotone in the edits too: two equally cheap ways to an item are never prefixes of each other, as the longer one would have
more inserts, which cost.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from types import SimpleNamespace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventide.llm.common import stage
from eventide.llm.turns import batched, in_order, listed

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BEGIN, SYSTEM, USER, ASSISTANT = range(4)  # what the last turn was
AFTER = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (BEGIN, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLOCK = 1024  # rows of one deduction
HELD = 16  # pieces of a conversation that a task holds, at most, to finish it by itself
SPACE = b" \t\n\x0b\x0c\r"


def damaged(turns: DataFrame) -> DataFrame:
    """Rows after the damage that crc32 of ``conv_id:turn`` modulo 20 does, as :func:`repair` takes them; nulls are one space.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 makes two of it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _edits(row: str) -> list[tuple[str, int, str]]:
    """(initial that comes out, cost, letter) of every edit of a row: ``d`` has to go, capitals are truncated, x is no role."""
    out = [("", DELETE, "D")]
    if row != "d":
        extra, x = (TRUNCATED if row.isupper() else 0), row.lower()
        out += [(x, extra, "K")] if x in "sua" else []
        out += [("u", REROLE + extra, "R"), ("a", REROLE + extra, "R")]
    return out


EDITS = {row: _edits(row) for row in "dsuaxSUAX"}


def lightest(pattern: str, entry: int = BEGIN, to_goal: bool = True) -> dict[int, tuple[int, str]]:
    """State at the end: (cost, edits) of the lightest derivation from ``entry``; with ``to_goal`` that of the goal alone.

    Items leave the agenda by weight.  It ends when the goal does, or, for a piece of a conversation, when all ends did.
    """
    n = len(pattern)
    agenda = [(0, "", 0, entry)]
    final: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, edits, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n:
            if not to_goal:
                ends[state] = cost, edits
                if len(ends) == 4:
                    break
            elif state in ACCEPTING:
                return {state: (cost, edits)}
        else:
            for x, more, letter in EDITS[pattern[i]]:
                after = AFTER.get((state, x)) if x else state
                if after is not None and (i + 1, after) not in final:
                    heapq.heappush(agenda, (cost + more, edits + letter, i + 1, after))
        for x in "ua":
            after = AFTER.get((state, x))
            if after is not None and (i, after) not in final:
                heapq.heappush(agenda, (cost + INSERT, edits + "I", i, after))
    return ends


_common = lru_cache(maxsize=1 << 15)(lightest)


def derive(pattern: str, entry: int, to_goal: bool) -> dict[int, tuple[int, str]]:
    """:func:`lightest`, remembered for short patterns."""
    return (_common if len(pattern) <= 32 else lightest)(pattern, entry, to_goal)


def turns_after(entry: int, edits: str, pattern: str, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every turn that comes out; ``rows`` are those that need not go."""
    state, i, live = entry, 0, iter(rows)
    for e in edits:
        role, text, initial = None, "", "u" if state != USER else "a"
        if e != "I":
            role, text = next(live) if pattern[i] != "d" else (None, "")
            i += 1
        if e == "D":
            continue
        if e == "K":
            initial = role[0]
        state = AFTER[state, initial]
        yield e, role if e == "K" else ROLE[state], text


class Digest:
    """SHA-256 of ``role:text`` lines with line feeds between, and the turns themselves if they are wanted."""

    def __init__(self, texts: bool):
        self.sha, self.any, self.turns = hashlib.sha256(), False, [] if texts else None

    def more(self, turns) -> "Digest":
        out = Digest(False)
        out.sha, out.any, out.turns = self.sha.copy(), self.any, None if self.turns is None else list(self.turns)
        for edit, role, text in turns:
            out.sha.update((("\n" if out.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            out.any = True
            if out.turns is not None:
                out.turns.append({"edit": edit, "role": role, "text": text})
        return out


_I, _L, _S = T.IntegerType(), T.LongType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_COUNTS = {n: _L for n in ("blank", "duplicate", "truncated", "illegal")}
_PIECE = _struct(
    conv_id=_L, part=_I, seq=_I, n=_L, **_COUNTS, first=_S, last=_S, low=_L, high=_L, n_turns=_L, first_turn=_L, last_turn=_L, pattern=_S,
    rows=T.ArrayType(_struct(role=_S, text=_S)), spans=T.ArrayType(_struct(entry=_I, exit=_I, cost=_L, edits=_S)),
)
_RESULT = _struct(
    conv_id=_L, gaps=_L, **_COUNTS, cost=_L, audit=_S, repaired_sha256=_S, repaired=T.ArrayType(_struct(edit=_S, role=_S, text=_S)),
)


class Piece:
    """A run of rows of one conversation."""

    __slots__ = ("blank", "duplicate", "first", "first_turn", "high", "illegal", "last", "last_turn", "low", "n", "n_turns",
                 "pattern", "rows", "truncated")

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first = self.last = self.low = self.high = self.first_turn = self.last_turn = None
        self.pattern: list[str] = []
        self.rows: list[tuple[str, str]] = []

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        x = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if self.n:
            self.illegal += self.last + x not in ("su", "ua", "au")
        else:
            self.first, self.first_turn = x, turn
        if turn is not None:
            self.n_turns += self.n == 0 or turn != self.last_turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.n, self.last, self.last_turn = self.n + 1, x, turn
        body = text.encode("utf-8", "surrogatepass").rstrip(SPACE)
        if not body:
            self.blank += 1
        elif again:
            self.duplicate += 1
        else:
            cut = body[-1:] not in (b".", b"!", b"?")
            self.truncated += cut
            self.pattern.append(x.upper() if cut else x)
            self.rows.append((role, text))
            return
        self.pattern.append("d")


class Fold:
    """Pieces of one conversation taken in order: sums, and the finalised items at the border between two pieces."""

    def __init__(self, conv_id: int | None, texts: bool):
        self.conv_id, self.texts = conv_id, texts
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = self.n = 0
        self.low = self.high = self.last = self.last_turn = None
        self.border = {BEGIN: (0, "", Digest(texts))}

    def take(self, p, spans: dict[int, dict[int, tuple[int, str]]]) -> None:
        """``spans``: by state before the piece, and state after it, the lightest derivation."""
        self.blank, self.duplicate, self.truncated = self.blank + p.blank, self.duplicate + p.duplicate, self.truncated + p.truncated
        self.illegal += p.illegal + (self.n > 0 and p.n > 0 and self.last + p.first not in ("su", "ua", "au"))
        same = self.n > 0 and p.n > 0 and p.first_turn is not None and p.first_turn == self.last_turn
        self.n_turns += p.n_turns - same
        self.low = p.low if self.low is None else self.low
        self.high = self.high if p.high is None else p.high
        if p.n:
            self.n, self.last, self.last_turn = self.n + p.n, p.last, p.last_turn
        best: dict[int, tuple[int, str, int, str]] = {}
        for entry, (cost, edits, _) in self.border.items():
            for state, (more, here) in spans[entry].items():
                new = (cost + more, edits + here, entry, here)
                if state not in best or new[:2] < best[state][:2]:
                    best[state] = new
        pattern = "".join(p.pattern)
        self.border = {
            state: (cost, edits, self.border[entry][2].more(turns_after(entry, here, pattern, p.rows)))
            for state, (cost, edits, entry, here) in best.items()
        }

    def result(self) -> dict:
        cost, audit, digest = min((self.border[s] for s in ACCEPTING if s in self.border), key=lambda x: x[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        values = (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.sha.hexdigest(),
                  digest.turns)
        return dict(zip(_RESULT.names, values, strict=True))


def _pieces(rows: Iterator[tuple], part: int, texts: bool, block: int, held: int) -> Iterator[tuple[dict | None, dict | None]]:
    """(piece, result): results of conversations inside this partition; pieces of the first and the last, which others may
    continue, and of long ones, so that no more than ``held`` pieces of ``block`` rows are in memory."""

    def finished(key, pieces: list[Piece]) -> tuple[None, dict]:
        fold = Fold(key, texts)
        for p in pieces:
            fold.take(p, {a: derive("".join(p.pattern), a, len(pieces) == 1) for a in fold.border})
        return None, fold.result()

    def opened(key, pieces: list[Piece], seq: int) -> Iterator[tuple[dict, None]]:
        for k, p in enumerate(pieces, seq):
            pattern = "".join(p.pattern)
            spans = [
                {"entry": a, "exit": b, "cost": c, "edits": e} for a in range(4) for b, (c, e) in derive(pattern, a, False).items()
            ]
            said = [{"role": r, "text": t} for r, t in p.rows]
            plain = {f: getattr(p, f) for f in Piece.__slots__}
            yield plain | {"conv_id": key, "part": part, "seq": k, "pattern": pattern, "rows": said, "spans": spans}, None

    key, pieces, seq, edge = None, [], 0, True
    for conv_id, turn, role, text, copies, fresh in rows:
        if pieces and conv_id != key:
            if edge:
                yield from opened(key, pieces, seq)
            else:
                yield finished(key, pieces)
            pieces, seq, edge = [], 0, False
        if not pieces:
            key, pieces = conv_id, [Piece()]
        for k in range(copies):
            if pieces[-1].n == block:
                if edge or len(pieces) == held:
                    yield from opened(key, pieces, seq)
                    pieces, seq, edge = [], seq + len(pieces), True
                pieces.append(Piece())
            pieces[-1].add(turn, role, text, bool(k) or not fresh)
    if pieces:
        yield from opened(key, pieces, seq)


def _chained(rows: Iterator[tuple], texts: bool) -> Iterator[tuple]:
    """Pieces, sorted by conversation, part and number, to results."""
    fold = None
    for r in rows:
        p = SimpleNamespace(**dict(zip(_PIECE.names, r, strict=True)))
        if fold is None or p.conv_id != fold.conv_id:
            if fold:
                yield tuple(fold.result().values())
            fold = Fold(p.conv_id, texts)
        p.rows = [(x["role"], x["text"]) for x in p.rows]
        spans: dict[int, dict[int, tuple[int, str]]] = {a: {} for a in range(4)}
        for s in p.spans:
            spans[s["entry"]][s["exit"]] = (s["cost"], s["edits"])
        fold.take(p, spans)
    if fold:
        yield tuple(fold.result().values())


def repair(rows: DataFrame, texts: bool = False, block: int = BLOCK, held: int = HELD) -> DataFrame:
    r"""Faults and cheapest repair of every conversation, one row for each conv_id.

    ``rows`` has conv_id, turn, role, text and, if wanted, copies: so many equal rows one after the other, 0 for a row that only
    says that its conversation exists.  Rows count by turn (nulls first), then role, then text; a null conv_id is a conversation,
    null roles and texts are one space, other columns are ignored.  Columns:

    gaps: highest less lowest turn plus one less the number of turns there are; 0 without any.
    blank, duplicate, truncated: each row counts for its first fault: nothing but ``\x20\x09-\x0D``; role and text seen earlier in the
    conversation; last other character none of ``.!?``.
    illegal: neighbouring rows whose initials are none of su, ua, au.
    cost, audit: cheapest edits, in letters Keep, Rerole, Delete, Insert; of equally cheap ones the least in ASCII.  An empty role has
    no initial and can't be kept.
    repaired_sha256: digest of the repaired lines ``role:text``.
    repaired: with ``texts``, the turns (edit, role, text); else null.

    Equal rows (by SHA-256 of the text) are counted before anything is ordered, and what is a repetition is found by text, not by
    conversation.  Conversations
    are then cut into pieces wherever a partition ends, and every ``block`` rows; a piece gives the lightest derivation from each state
    to each other, and pieces are joined in order: what stays in memory is a piece, and the edits so far of at most four items.
    """
    c = F.col
    space = lambda n: F.coalesce(c(n).cast("string"), F.lit(" "))
    copies = c("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    rows = rows.select(c("conv_id").cast("long"), c("turn").cast("long"), space("role").alias("role"), space("text").alias("text"),
                       copies.alias("copies"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")  # stands for the text wherever the text itself isn't needed
    marks = rows.select("conv_id", F.when(c("copies") > 0, c("turn")).alias("turn"),
                        *[F.when(c("copies") > 0, c(n)).otherwise("").alias(n) for n in ("role", "text")], "copies", F.lit(0).alias("fresh")).withColumn("digest", digest)
    first = F.min(F.struct(c("turn").isNotNull().alias("some"), "turn")).alias("t")
    firsts = rows.where("copies > 0").groupBy("conv_id", "role", digest).agg(first)
    firsts = firsts.select("conv_id", c("t.turn").alias("turn"), "role", F.lit(None).cast("string").alias("text"),
                           F.lit(0).cast("long").alias("copies"), F.lit(1).alias("fresh"), "digest")
    counted = marks.unionByName(firsts).groupBy("conv_id", "turn", "role", "digest").agg(
        F.max("text").alias("text"), F.sum("copies").alias("copies"), F.max("fresh").alias("fresh")).drop("digest")
    schema = _struct(piece=_PIECE, result=_RESULT)
    arrow, result = to_arrow_schema(schema), to_arrow_schema(_RESULT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(_pieces(listed(batches), TaskContext.get().partitionId(), texts, block, held), arrow)

    told = stage(in_order(counted).mapInArrow(cut, schema))
    whole = told.where("result IS NOT NULL").select("result.*")
    open_ones = told.where("piece IS NOT NULL").select("piece.*")
    open_ones = open_ones.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.unionByName(open_ones.mapInArrow(lambda b: batched(_chained(listed(b, 16), texts), result), _RESULT))
