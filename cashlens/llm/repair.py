"""Conversations whose roles break the grammar, repaired at least cost by a generalised LR parser with edit actions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.grammar import Grammar, Stacks
from cashlens.llm.shelf import Shelf

#: Role initials of a sound conversation: perhaps a system turn, then pairs of user and assistant; or nothing.
ROLES: Grammar = [("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("P",)), ("T", ("T", "P")), ("P", ("u", "a"))]
#: Roles that an edit can give, by initial.
GIVEN = {"a": "assistant", "u": "user"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Neighbouring initials that follow each other in the grammar.
LEGAL = frozenset({"su", "ua", "au"})
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Rows of an edge segment that travel in one record.
CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 20

#: (stack, cost above the least, place of its audit among the others' in ASCII order), one for each stack.
Frontier = tuple[tuple[int, int, int], ...]
#: For each stack after a row: (stack before it, by index; letters added to the audit; initials added).
Back = tuple[tuple[int, str, str], ...]


class Repairer:
    """The parser. A row takes each stack to others by keep, rerole, delete and insertions before; equal stacks merge by
    least (cost, audit). Where a frontier goes depends on few things, so it is worked out once and looked up after.

    No audit of a frontier begins with another's: each ends with the letter of the last row. So their order never
    changes later, and a place among them stands for the whole audit.
    """

    def __init__(self, grammar: Grammar = ROLES):
        self.stacks = Stacks(grammar)
        self.entries = [0]
        for node in self.entries:  # grows; always in the same order, so numbers agree between tasks
            for symbol in self.stacks.tables.terminals:
                self.entries += [to for to in self.stacks.step(node, symbol) if to not in self.entries]
        self._inserted: dict[int, list[tuple[int, str]]] = {}
        self._steps: dict[tuple[Frontier, str, str], tuple[Frontier, int, Back]] = {}

    def inserted(self, node: int) -> list[tuple[int, str]]:
        """(stack, initials inserted) for each stack that insertions reach, by fewest of them."""
        if node not in self._inserted:
            found = {node: ""}
            todo = [node]
            for at in todo:
                for symbol in GIVEN:
                    for to in self.stacks.step(at, symbol):
                        if to not in found:
                            found[to] = found[at] + symbol
                            todo.append(to)
            self._inserted[node] = list(found.items())
        return self._inserted[node]

    def _row(self, frontier: Frontier, initial: str, fault: str) -> tuple[Frontier, int, Back]:
        best: dict[int, tuple[int, int, str, str, int]] = {}

        def offer(node: int, *found) -> None:
            if node not in best or found < best[node]:
                best[node] = found

        late = TRUNCATED if fault == "truncated" else 0
        for i, (node, cost, place) in enumerate(frontier):
            for at, added in self.inserted(node):
                paid, letters = cost + INSERT * len(added), "I" * len(added)
                offer(at, paid + DELETE, place, letters + "D", added, i)
                if fault in ("blank", "duplicate"):
                    continue
                for to in self.stacks.step(at, initial):
                    offer(to, paid + late, place, letters + "K", added + initial, i)
                for symbol in GIVEN:
                    for to in self.stacks.step(at, symbol):
                        offer(to, paid + REROLE + late, place, letters + "R", added + symbol, i)
        least = min(found[0] for found in best.values())
        order = {audit: n for n, audit in enumerate(sorted({found[1:4] for found in best.values()}))}
        nodes = sorted(best)
        after = tuple((node, best[node][0] - least, order[best[node][1:4]]) for node in nodes)
        return after, least, tuple((best[node][4], best[node][2], best[node][3]) for node in nodes)

    def row(self, frontier: Frontier, initial: str, fault: str) -> tuple[Frontier, int, Back]:
        key = (frontier, initial if fault in ("", "truncated") else "", fault)
        if key not in self._steps:
            self._steps[key] = self._row(frontier, initial, fault)
        return self._steps[key]

    def paths(self, entry: int, rows: list[tuple[str, str, int]]) -> dict[int, tuple[int, str, str]]:
        """Exit stack -> (cost, audit, initials) of the cheapest edits of rows (initial, fault, times) from a stack."""
        frontier: Frontier = ((entry, 0, 0),)
        cost, backs = 0, []
        for initial, fault, times in rows:
            while times:
                after, more, back = self.row(frontier, initial, fault)
                # Once copies that must go change nothing else, all further ones are alike.
                same = after == frontier and all(b == (i, "D", "") for i, b in enumerate(back))
                run = times if same else 1
                backs.append((back, run))
                cost += more * run
                times -= run
                frontier = after
        found = {}
        for i, (node, above, _) in enumerate(frontier):
            letters, initials = [], []
            for back, run in reversed(backs):
                i, added, given = back[i]
                letters.append(added * run)
                initials.append(given)
            found[node] = (cost + above, "".join(reversed(letters)), "".join(reversed(initials)))
        return found

    def end(self, exits: dict[int, tuple[int, str, str]]) -> tuple[int, str, str]:
        """The cheapest whole edit: exits and the insertions that make the conversation complete."""
        return min(
            (cost + INSERT * len(added), audit + "I" * len(added), initials + added)
            for node, (cost, audit, initials) in exits.items()
            for to, added in self.inserted(node)
            if self.stacks.accepts(to)
        )


@dataclass
class Turn:
    """A row that stands `copies` times, at one turn."""

    turn: int | None
    role: str
    text: str
    copies: int
    seen: bool

    def faults(self) -> list[tuple[str, int]]:
        """(fault, times): a row's first fault of blank, duplicate, truncated."""
        bare = self.text.strip(WHITE)
        if not bare:
            return [("blank", self.copies)]
        if self.seen:
            return [("duplicate", self.copies)]
        first = ("" if bare[-1] in ENDS else "truncated", 1)
        return [first, ("duplicate", self.copies - 1)] if self.copies > 1 else [first]


def edited(turns: list[tuple[str, str, int]], audit: str, initials: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that remain of (role, text, copies), by an audit and the initials it gives."""
    rows = iter(turns)
    role, text, left = "", "", 0
    given = iter(initials)
    i = 0
    while i < len(audit):
        letter = audit[i]
        if letter == "I":
            yield "I", GIVEN[next(given)], ""
            i += 1
            continue
        while not left:
            role, text, left = next(rows)
        if letter == "D":
            run = 1
            while run < left and i + run < len(audit) and audit[i + run] == "D":
                run += 1
            left -= run
            i += run
            continue
        symbol = next(given)
        yield letter, role if letter == "K" else GIVEN[symbol], text
        left -= 1
        i += 1


class _Digest:
    """SHA-256 of `role:text` lines, fed one at a time."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True


_FACTS = "min_turn long, max_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
_OUT = "edit string, role string, text string, cost long, audit string, repaired_sha256 string"


def _facts(turns: list[Turn]) -> dict:
    numbers = [t.turn for t in turns if t.turn is not None]
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    illegal, before = 0, None
    for t in turns:
        for fault, times in t.faults():
            if fault:
                counts[fault] += times
        own = t.role[:1]
        illegal += before is not None and before + own not in LEGAL
        illegal += (t.copies - 1) * (own + own not in LEGAL)
        before = own
    ends = {"first": turns[0].role[:1], "last": turns[-1].role[:1]} if turns else {}
    return {
        "min_turn": min(numbers, default=None),
        "max_turn": max(numbers, default=None),
        "n_turns": len(set(numbers)),
        **counts,
        "illegal": illegal,
        **ends,
    }


def _rows(turns: list[Turn]) -> list[tuple[str, str, int]]:
    return [(t.role[:1], fault, times) for t in turns for fault, times in t.faults()]


class _Records:
    """Records of one schema, handed on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, size: int = 0, **values) -> Iterator[pa.RecordBatch]:
        self.rows.append(values)
        self.chars += size
        if len(self.rows) >= CHUNK_ROWS * 4 or self.chars >= CHUNK_CHARS * 4:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array([r.get(f.name) for r in self.rows], f.type) for f in self.schema]
            self.rows, self.chars = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _turn_records(out: _Records, conv, part: int, place: int, kept, digest: _Digest, with_turns: bool):
    """Feeds the digest; hands on the turns, if asked for. Returns the place after the last one."""
    for edit, role, text in kept:
        digest.add(role, text)
        if with_turns:
            yield from out.add(len(text), kind="turn", conv=conv, part=part, chunk=place, edit=edit, role=role, text=text)
        place += 1
    return place


def _segments(schema: pa.Schema, grammar: Grammar, with_turns: bool) -> Callable:
    """Sorted rows to conversations, for those that lie wholly inside a partition, and to edge segments."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, out, part = Repairer(grammar), _Records(schema), TaskContext.get().partitionId()

        def close(conv, turns: list[Turn], edge: bool):
            facts = _facts(turns)
            if not edge:
                cost, audit, initials = repairer.end(repairer.paths(0, _rows(turns)))
                digest = _Digest()
                kept = edited([(t.role, t.text, t.copies) for t in turns], audit, initials)
                yield from _turn_records(out, conv, part, 0, kept, digest, with_turns)
                sha = digest.sha.hexdigest()
                yield from out.add(len(audit), kind="whole", conv=conv, part=part, chunk=0, cost=cost, audit=audit, repaired_sha256=sha, **facts)
                return
            rows = _rows(turns)
            matrix = json.dumps([[entry, sorted(repairer.paths(entry, rows).items())] for entry in repairer.entries])
            yield from out.add(len(matrix), kind="edge", conv=conv, part=part, chunk=-1, matrix=matrix, **facts)
            start, chars = 0, 0
            for i, t in enumerate(turns, 1):
                chars += len(t.text)
                if i == len(turns) or i - start >= CHUNK_ROWS or chars >= CHUNK_CHARS:
                    cut = turns[start:i]
                    lists = {"roles": [x.role for x in cut], "texts": [x.text for x in cut], "copies": [x.copies for x in cut]}
                    yield from out.add(chars, kind="rows", conv=conv, part=part, chunk=start, **lists)
                    start, chars = i, 0

        conv, turns, n_convs, key, mark = None, [], 0, None, None
        for batch in batches:
            for c, turn, role, digest, text, copies in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "digest", "text", "copies"))):
                if not n_convs or c != conv:
                    if n_convs:
                        yield from close(conv, turns, n_convs == 1)
                    conv, turns, key, mark = c, [], None, None
                    n_convs += 1
                if copies is None:  # a mark: role and text are first seen at this turn
                    mark = (turn, role, digest)
                elif copies and key == (turn, role, digest):
                    turns[-1].copies += copies
                elif copies:
                    key = (turn, role, digest)
                    turns.append(Turn(turn, role, text, copies, mark != key))
        if n_convs:
            yield from close(conv, turns, True)
        yield from out.flush()

    return segments


def _joined(grammar: Grammar, schema: pa.Schema) -> Callable:
    """Edge segments of each conversation, collected in order, to its result and the edits of each segment."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, out = Repairer(grammar), _Records(schema)
        for batch in batches:
            for conv, segments in zip(batch.column("conv").to_pylist(), batch.column("segments").to_pylist()):
                segments.sort(key=lambda s: s["part"])
                found = {0: (0, "", "")}
                cuts: dict[int, list[tuple[int, int]]] = {0: []}
                for s in segments:
                    after: dict[int, tuple[int, str, str]] = {}
                    ends: dict[int, list[tuple[int, int]]] = {}
                    for entry, exits in json.loads(s["matrix"]):
                        if entry not in found:
                            continue
                        cost, audit, initials = found[entry]
                        for to, (more, letters, given) in exits:
                            path = (cost + more, audit + letters, initials + given)
                            if to not in after or path < after[to]:
                                after[to] = path
                                ends[to] = [*cuts[entry], (len(path[1]), len(path[2]))]
                    found, cuts = after, ends
                cost, audit, initials = repairer.end(found)
                # The exit that the whole edit comes from: its audit goes on with insertions only.
                node = next(
                    n for n, (paid, letters, given) in found.items()
                    for to, added in repairer.inserted(n)
                    if repairer.stacks.accepts(to) and (paid + INSERT * len(added), letters + "I" * len(added), given + added) == (cost, audit, initials)
                )
                ends = cuts[node]
                ends[-1] = (len(audit), len(initials))
                counts = {k: sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal", "n_turns")}
                filled = [s for s in segments if s["first"] is not None]
                for a, b in zip(filled, filled[1:]):
                    counts["illegal"] += a["last"] + b["first"] not in LEGAL
                numbered = [s for s in segments if s["max_turn"] is not None]
                for a, b in zip(numbered, numbered[1:]):
                    counts["n_turns"] -= a["max_turn"] == b["min_turn"]
                low, high = (numbered[0]["min_turn"], numbered[-1]["max_turn"]) if numbered else (None, None)
                yield from out.add(len(audit), kind="joined", conv=conv, part=-1, chunk=-1, min_turn=low, max_turn=high, cost=cost, audit=audit, **counts)
                at = (0, 0)
                for s, end in zip(segments, ends):
                    piece = {"audit": audit[at[0] : end[0]], "role": initials[at[1] : end[1]]}
                    yield from out.add(len(piece["audit"]), kind="plan", conv=conv, part=s["part"], chunk=-1, **piece)
                    at = end
        yield from out.flush()

    return joined


def _applied(schema: pa.Schema, with_turns: bool) -> Callable:
    """The chunks of edge conversations, in order and each segment after its plan, to turns and a digest.

    A SHA-256 is one pass over a conversation's text, so one task reads its chunks one after another; it holds a
    segment at a time.
    """

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Records(schema)
        state: dict = {}

        def settle():
            if state.get("plan") is not None:
                kept = edited(state["rows"], *state["plan"])
                state["place"] = yield from _turn_records(out, state["conv"], state["part"], state["place"], kept, state["digest"], with_turns)
            state["plan"], state["rows"] = None, []

        def close():
            yield from settle()
            if "conv" in state:
                yield from out.add(kind="digest", conv=state["conv"], part=-1, chunk=-1, repaired_sha256=state["digest"].sha.hexdigest())

        for batch in batches:
            names = ("kind", "conv", "part", "audit", "role", "roles", "texts", "copies")
            for kind, conv, part, audit, initials, roles, texts, copies in zip(*(batch.column(n).to_pylist() for n in names)):
                if "conv" not in state or conv != state["conv"]:
                    yield from close()
                    state = {"conv": conv, "place": 0, "digest": _Digest()}
                if kind == "plan":
                    yield from settle()
                    state |= {"plan": (audit, initials), "part": part, "rows": []}
                else:
                    state["rows"] += zip(roles, texts, copies)
        yield from close()
        yield from out.flush()

    return applied


@dataclass
class Repaired:
    """`conversations`: one row each. `turns`: conv, part, place, edit, role, text of what remains, if asked for."""

    conversations: DataFrame
    turns: DataFrame | None


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one row."""
    for batch in batches:
        keys = ["conv", "turn", "role", "digest", "text"]
        table = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("copies", "sum")])
        yield from table.select([*keys, "copies_sum"]).rename_columns([*keys, "copies"]).to_batches()


def repair(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    copies: str = "1",
    grammar: Grammar = ROLES,
    with_turns: bool = False,
) -> Repaired:
    """Faults of each conversation and its cheapest repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    Rows are taken by turn (nulls first, then by role and a digest of the text). `copies`, an SQL expression, says how
    often a row stands there; a conversation of rows that stand 0 times is empty: zeros, an empty audit, the hash of
    nothing. Null roles and texts count as one space; a null conversation is one of its own. Repeated rows are faults
    (duplicates), not errors. An empty table gives no rows; other columns are ignored.

    Rows are sorted by conversation across all tasks, so a huge conversation is cut into the segments that lie in
    different tasks. A conversation inside a task is parsed at once. A segment at the edge of a task is parsed from every
    stack that the grammar allows; a table of two segments a task at most then joins them, and the edits go back to their
    rows. The grammar must have finitely many stacks, as one for roles in turn has. A conversation's audit is one string
    of at most 2 GiB.
    """
    shelf = Shelf(rows.sparkSession, "repair")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    stands = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        blank(role_col).alias("role"),
        blank(text_col).alias("text"),
        F.expr(copies).cast("long").alias("copies"),
    )
    # What doesn't stand leaves one empty row of no copies behind, so that its conversation is known.
    none = F.col("copies") == 0
    for name, empty in (("turn", F.lit(None).cast("long")), ("role", F.lit("")), ("text", F.lit(""))):
        stands = stands.withColumn(name, F.when(none, empty).otherwise(F.col(name)))
    shape = f"conv {stands.schema['conv'].dataType.simpleString()}, turn long, role string, digest binary, text string, copies long"
    named = stands.select("conv", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text", "copies")
    ready = shelf.put(named.mapInArrow(_collapsed, shape))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = ready.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min(when).alias("first"))
    marks = firsts.select("conv", F.col("first.turn").alias("turn"), "role", "digest", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"))
    order = ["conv", "turn", "role", "digest"]
    ordered = ready.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "copies")
    kind = ready.schema["conv"].dataType.simpleString()
    schema = f"kind string, conv {kind}, part int, chunk long, {_FACTS}, {_OUT}, matrix string, roles array<string>, texts array<string>, copies array<long>"
    arrow = _arrow_schema(ready, schema)
    parsed = shelf.put(ordered.mapInArrow(_segments(arrow, grammar, with_turns), schema))
    edges = parsed.where("kind = 'edge'").groupBy("conv").agg(
        F.collect_list(F.struct("part", "matrix", *[f.split()[0] for f in _FACTS.split(", ")])).alias("segments")
    )
    settled = shelf.put(edges.mapInArrow(_joined(grammar, arrow), schema))
    chunks = parsed.where("kind = 'rows'").unionByName(settled.where("kind = 'plan'"))
    chunks = chunks.repartition("conv").sortWithinPartitions("conv", "part", "chunk")
    done = shelf.put(chunks.mapInArrow(_applied(arrow, with_turns), schema))
    digests = done.where("kind = 'digest'").select(F.col("conv").alias("of"), F.col("repaired_sha256").alias("sha"))
    one = ["conv", "min_turn", "max_turn", "n_turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = parsed.where("kind = 'whole'").select(*one, "repaired_sha256")
    split = settled.where("kind = 'joined'").join(digests, F.col("conv").eqNullSafe(F.col("of"))).select(*one, F.col("sha").alias("repaired_sha256"))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    conversations = whole.unionByName(split).select(F.col("conv").alias(conv_col), gaps.alias("gaps"), *one[4:], "repaired_sha256")
    turns = None
    if with_turns:
        turns = parsed.unionByName(done).where("kind = 'turn'")
        turns = turns.select(F.col("conv").alias(conv_col), F.col("chunk").alias("place"), "edit", "role", "text")
    return Repaired(conversations, turns)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
