import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from cashlens.llm import queries, repair
from cashlens.llm.grammar import Stacks

SOLID = re.compile("[^\x20\x09-\x0d]")
SHAPE = "conv_id long, turn long, role string, text string, stands int, conv string, part int, copies string, chunk int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 1, "x", 1) for r in rows], SHAPE)


def faults(rows):
    """Of (role, text) in order: each row's first fault."""
    seen, out = set(), []
    for role, text in rows:
        solid = SOLID.findall(text)
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


#: Output so far -> output after a role initial.
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, lines) by whole audits over all states; insertions are tried before every row and at the end."""
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(4):
            for state, (cost, audit, lines) in list(states.items()):
                for symbol in "ua":
                    to, offer = MOVES.get((state, symbol)), (cost + 2, audit + "I", [*lines, f"{names[symbol]}:"])
                    if to is not None and (to not in states or offer < states[to]):
                        states[to] = offer
        return states

    states = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows)):
        after = {}

        def offer(to, found):
            if to is not None and (to not in after or found < after[to]):
                after[to] = found

        # A path that inserts first is another one than the path as it stands, so both are kept apart.
        for state, (cost, audit, lines) in [*states.items(), *inserted(dict(states)).items()]:
            offer(state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            offer(MOVES.get((state, role[:1])), (cost + late, audit + "K", [*lines, f"{role}:{text}"]))
            for symbol in "ua":
                offer(MOVES.get((state, symbol)), (cost + 2 + late, audit + "R", [*lines, f"{names[symbol]}:{text}"]))
        states = after
    return min(found for state, found in inserted(states).items() if state in ("", "a"))


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest())


def brute(rows):
    """rows: (conv, turn, role, text) as they stand."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, found in convs.items():
        found.sort(key=order)
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        plain = [(role, text) for _, role, text in found]
        kinds = faults(plain)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        cost, audit, lines = cheapest(plain)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha)
    return out


def got(df):
    rows = {r.conv_id: tuple(r)[1:] for r in df.collect()}
    assert len(rows) == df.count()
    return rows


def random_rows(rng, convs, most):
    rows = []
    for conv in range(convs):
        size = rng.randint(1, most)
        for _ in range(size):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "u", "", None])
            text = rng.choice(["A.", "b?", " c! ", "d", "é", "", " \t", None, "e.\n", f"{rng.randint(0, 9)}."])
            rows.append((conv, rng.choice([None, *range(size)]), role, text))
    return rows


@pytest.fixture
def scattered(spark):
    """Partitions stay as small as they are dealt, so that conversations are cut at their edges."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "7")
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def test_grammar():
    stacks = Stacks(repair.ROLES)
    tops = {"": {0}}
    for _ in range(7):
        tops |= {w + c: {to for t in found for to in stacks.step(t, c)} for w, found in tops.items() for c in "sua"}
    for word, found in tops.items():
        assert any(stacks.accepts(t) for t in found) == bool(re.fullmatch("(s?(ua)+)?", word))


def test_ambiguous_grammar():
    """Both readings of a conflict are followed; nested brackets need deeper stacks."""
    stacks = Stacks([("E", ("E", "+", "E")), ("E", ("x",)), ("E", ("(", "E", ")"))])

    def accepted(word):
        tops = {0}
        for c in word:
            tops = {to for t in tops for to in stacks.step(t, c)}
        return any(stacks.accepts(t) for t in tops)

    assert all(map(accepted, ["x", "x+x+x", "((x)+x)+x"])) and not any(map(accepted, ["", "x+", "(x", "x)x", "xx"]))


def test_exhaustive():
    """Every edit sequence of short conversations, with up to four insertions."""
    repairer = repair.Repairer()
    names = {"u": "user", "a": "assistant"}

    def all_edits(rows, kinds, inserts):
        if inserts:
            for rest in all_edits(rows, kinds, inserts - 1):
                for symbol in "ua":
                    yield rest[0] + 2, "I" + rest[1], symbol + rest[2]
        if not rows:
            yield 0, "", ""
            return
        for cost, audit, out in all_edits(rows[1:], kinds[1:], inserts):
            yield cost + 3, "D" + audit, out
            if kinds[0] not in ("blank", "duplicate"):
                late = kinds[0] == "truncated"
                yield cost + late, "K" + audit, rows[0][0][:1] + out
                for symbol in names:
                    yield cost + 2 + late, "R" + audit, symbol + out

    rng = random.Random(1)
    for _ in range(120):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "b", "", "C?"])) for _ in range(rng.randint(0, 3))]
        kinds = faults(rows)
        want = min(e for e in all_edits(rows, kinds, 3) if re.fullmatch("(s?(ua)+)?", e[2]))
        assert repairer.end(repairer.paths(0, [(r[:1], k, 1) for (r, _), k in zip(rows, kinds)])) == want
        assert cheapest(rows)[:2] == want[:2]


def test_random_conversations(scattered):
    rows = random_rows(random.Random(2), 150, 9) + [(None, 1, "user", "hi."), (None, 2, "assistant", "yes.")]
    assert got(repair.repair(table(scattered, rows)).conversations) == brute(rows)


def test_conversation_cut_into_segments(scattered):
    """One conversation holds most rows, many of them equal; its segments lie in several tasks."""
    rng = random.Random(3)
    rows = random_rows(rng, 12, 5)
    for turn in range(1200):
        rows.append((50, turn // 2 if rng.random() < 0.9 else None, rng.choice(["user", "assistant"]), f"{rng.randint(0, 700)}{rng.choice('.?x')}"))
    rows += [(50, 77, "user", "same.")] * 300 + [(50, None, "tool", " ")] * 40
    result = repair.repair(table(scattered, rows), with_turns=True)
    want = brute(rows)
    assert got(result.conversations) == want
    turns = defaultdict(list)
    for r in result.turns.orderBy("conv_id", "place").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, found in want.items():
        assert hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest() == found[-1]


def test_edges(spark):
    empty = table(spark, [(1, 1, "user", "x")]).limit(0)
    assert repair.repair(empty).conversations.count() == 0
    rows = [(1, None, None, None), (2, 5, "user", "z" * 300_000 + "."), (2, 9, "assistant", "end"), (3, 1, "system", "only.")]
    assert got(repair.repair(table(spark, rows)).conversations) == brute(rows)
    gone = got(repair.repair(table(spark, [(7, 1, "user", "a."), (7, 2, "user", "b.")]), copies="0").conversations)
    assert gone == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def after_damage(rows):
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if way == 4 else role
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(way, 1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(after_damage(rows))
    for conv in {r[0] for r in rows} - set(want):
        want[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(queries.op12_conversation_repair(spark, f"/root/testdata/{sf}")) == want
