import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from reviewloom.llm import conversations
from reviewloom.llm.common import stored

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, audit STRING"
WHITE = " \t\n\x0b\x0c\r"
ADD = {"K": 0, "R": 1, "D": 2, "I": 5}


def by_strings(rows):
    """Cheapest edits by comparing (cost, audit) pairs. Rows are (initial, unusable, truncated)."""
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def insert(nodes):
        for _ in range(4):
            for state, (cost, audit) in list(nodes.items()):
                for to in set(steps[state].values()) - {"s"}:
                    nodes[to] = min(nodes.get(to, (1e18,)), (cost + 5, audit + "I"))
        return nodes

    nodes = {"": (0, "")}
    for initial, unusable, truncated in rows:
        after = {}
        for state, (cost, audit) in insert(nodes).items():
            found = [(state, cost + 2, "D")]
            if not unusable:
                more = cost + 5 * truncated
                if initial in steps[state]:
                    found.append((steps[state][initial], more, "K"))
                found += [(to, more + 1, "R") for to in set(steps[state].values()) - {"s"}]
            for to, total, letter in found:
                after[to] = min(after.get(to, (1e18,)), (total, audit + letter))
        nodes = after
    nodes = insert(nodes)
    return min(nodes[end] for end in ("", "a") if end in nodes)


def by_enumeration(rows):
    """All edits with at most two insertions between rows."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    choices = [["K", "Ru", "Ra", "D"]] * len(rows)
    for gaps in product(inserts, repeat=len(rows) + 1):
        for edits in product(*choices):
            roles, audit, cost = "", "", 0
            for gap, edit, (initial, unusable, truncated) in zip(gaps, [*edits], rows):
                roles += gap
                audit += "I" * len(gap)
                audit += edit[0]
                cost += ADD[edit[0]] + 5 * len(gap)
                if edit != "D":
                    cost += 5 * truncated + 10**9 * unusable
                    roles += edit[1:] or initial or "?"
            roles, audit, cost = roles + gaps[-1], audit + "I" * len(gaps[-1]), cost + 5 * len(gaps[-1])
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def by_numbers(rows):
    repair = conversations.Repair()
    for row in rows:
        repair.add(*row)
    return repair.finish()


def some_rows(rng, n, roles="uuaasx"):
    return [(rng.choice(roles), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]


def test_small_conversations():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3):
        rows = some_rows(rng, n)
        assert by_numbers(rows) == by_strings(rows) == by_enumeration(rows)


@pytest.mark.parametrize("roles", ["uuaasx", "ua", "uuuuuua", "s", "x", "sssu", "aaau"])
def test_numbers_agree_with_strings(roles):
    rng = random.Random(len(roles))
    for n in [*range(12), 40, 63, 64, 65, 66, 200, 700]:
        rows = some_rows(rng, n, roles)
        assert by_numbers(rows) == by_strings(rows)


def test_long_conversations_stay_short_numbers():
    rng = random.Random(4)
    rows = some_rows(rng, 20_000)
    repair = conversations.Repair()
    longest = 0
    for row in rows:
        repair.add(*row)
        longest = max(longest, repair.room)
    assert repair.finish() == by_strings(rows) and longest < 1000
    for rows in ([("u", False, False)] + [("u", True, False)] * 3000, [("s", False, False)] * 3000):
        assert by_numbers(rows) == by_strings(rows)


def brute(rows):
    """The whole report in plain Python."""
    by_conv = {}
    for conv_id, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        mine = by_conv.setdefault(conv_id, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        if kind != 0:
            for copy in range(2 if kind == 3 else 1):
                digest = hashlib.sha256(text.encode()).hexdigest()
                mine.append((turn is not None, turn or 0, role, digest, copy, text, turn))
    out = {}
    for conv_id, mine in by_conv.items():
        seen, faults, coded = set(), [], []
        mine.sort()
        for *_, role, _, _, text, _ in mine:
            shown = text.rstrip(WHITE)
            fault = ("blank" if not shown else "duplicate" if (role, text) in seen
                     else "truncated" if shown[-1] not in ".!?" else "none")
            seen.add((role, text))
            faults.append(fault)
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = by_strings(coded)
        lines, i, after = [], 0, ""
        for letter in audit:
            here = "assistant" if after == "u" else "user"
            if letter == "I":
                lines.append(f"{here}:")
                after = here[0]
                continue
            role, text = mine[i][2], mine[i][5]
            i += 1
            if letter != "D":
                role = role if letter == "K" else here
                lines.append(f"{role}:{text}")
                after = role[0]
        turns = {x[6] for x in mine} - {None}
        pairs = [x[0] + y[0] for x, y in zip(coded, coded[1:])]
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def report(df):
    rows = conversations.damaged(df)
    found = conversations.repair_report(rows, stored(conversations.audits(rows), "audits")).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in found}, rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for conv in range(300):
        for turn in range(rng.randrange(1, 12)):
            text = rng.choice(["Yes.", "No!", " \t", "", "Half", "Ends. \n", "é\U0001f600", None, "Yes.", "a?b"])
            out.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", None, "", "User"]), text, "x"))
    out += [(None, t, r, "t.", "x") for t, r in ((None, "user"), (1, "assistant"), (None, "user"), (4, None), (2**60, "user"))]
    out += [(1000, 3, "user", "same.", "x")] * 4 + [(1001, None, "user", f"{i}.", "x") for i in range(5)]
    out += [(2000, t, "user" if t % 2 == 0 else "assistant", "long. " * 40_000, "x") for t in range(4)]
    out += [(3000, t, rng.choice(["user", "assistant"]), f"{t}.", "x") for t in range(3000)]
    return out


def test_report(spark, rows):
    found, _ = report(spark.createDataFrame(rows, SCHEMA).repartition(6))
    wanted = brute(rows)
    assert found == wanted
    assert any(w[6] == "" and w[7] == hashlib.sha256(b"").hexdigest() for w in wanted.values())


def test_repaired_rows_give_the_hash(spark, rows):
    found, damage = report(spark.createDataFrame(rows, SCHEMA))
    made = {}
    for r in sorted(conversations.repaired(damage, conversations.audits(damage)).collect(), key=lambda r: r.place):
        made.setdefault(r.conv_id, []).append(r)
    for conv, values in found.items():
        lines = made.get(conv, [])
        assert [r.place for r in lines] == list(range(len(lines)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in lines))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == values[-1]


def test_empty_table(spark):
    assert report(spark.createDataFrame([], SCHEMA))[0] == {}


def test_query(spark):
    from reviewloom.llm.queries import op12_integer_weight_repair

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    found = {r.conv_id: tuple(r[f] for f in FIELDS) for r in op12_integer_weight_repair(spark, sf).collect()}
    assert found == brute(rows)
