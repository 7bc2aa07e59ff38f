import hashlib
import random
import re

import duckdb
import pytest

from pagemill.llm.conversations import BLANK, DUPLICATE, TRUNCATED, Costs, Repair, audit, damaged, repaired

FORM = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, audit string, kind int"


def cheapest(rows, costs, insertions=3):
    """(cost, edits) by trying every string of edits with at most `insertions` insertions in a row."""
    best = None

    def walk(i, initials, cost, edits, run):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and FORM.fullmatch(initials) and (best is None or (cost, edits) < best):
            best = (cost, edits)
        if i < len(rows):
            fault, initial = rows[i]
            walk(i + 1, initials, cost + costs.delete, edits + "D", 0)
            if fault not in (BLANK, DUPLICATE):
                more = cost + (costs.truncated if fault == TRUNCATED else 0)
                walk(i + 1, initials + initial, more, edits + "K", 0)
                for given in "ua":
                    walk(i + 1, initials + given, more + costs.rerole, edits + "R", 0)
        if run < insertions:
            for given in "ua":
                walk(i, initials + given, cost + costs.insert, edits + "I", run + 1)

    walk(0, "", 0, "", 0)
    return best


@pytest.mark.parametrize("costs", [Costs(), Costs(1, 2, 1, 0), Costs(2, 3, 1, 1), Costs(1, 1, 1, 1), Costs(0, 2, 2, 0)])
def test_search_against_all_edits(costs):
    r = random.Random(str(costs))
    for _ in range(120):
        rows = [(r.choice([0, 0, 0, 3, 1, 2]), r.choice("suaax")) for _ in range(r.randrange(5))]
        edits, left = [], []
        search = Repair(costs, lambda edit, row: (edits.append(edit), left.append(row) if row else None))
        for fault, initial in rows:
            search.push(fault, initial, (0, initial, b""))
        assert (search.finish(), "".join(edits)) == cheapest(rows, costs)
        assert FORM.fullmatch("".join(x[1][0] for x in left))


def test_what_is_held_stays_small():
    """Nodes of the tree, at any time, in a long conversation with faults of all kinds."""
    r, most, edits = random.Random(3), 0, []
    search = Repair(Costs(), lambda edit, row: edits.append(edit))
    for i in range(20_000):
        search.push(r.choice([0] * 12 + [1, 2, 3]), r.choice(["ua"[i % 2]] * 9 + ["s"]), (i, "", b""))
        most = max(most, search.unsettled())
    search.finish()
    assert len(edits) == 20_000 and most < 100


def test_an_unresolved_tie_is_kept_whole():
    """Deleting all or giving both rows a role cost the same until a system turn comes, or none does."""
    for rows in (["a", "u", *"x" * 40, "s", "u", "a"], ["a", "u", *"x" * 40, "u", "a"]):
        edits = []
        search = Repair(Costs(rerole=1, delete=1), lambda edit, row: edits.append(edit))
        for x in rows:
            search.push(BLANK if x == "x" else 0, x, (0, x, b""))
        cost = search.finish()
        want = "DD" + "D" * 40 + "KKK" if "s" in rows else "DD" + "D" * 40 + "KK"
        assert (cost, "".join(edits)) == (42, want)


def test_costs_are_checked():
    with pytest.raises(ValueError):
        Repair(Costs(insert=0), print)


def plain(rows):
    """What audit() gives, from (conv_id, turn, role, text) rows, by the exhaustive search for short ones."""
    space, out = " \t\n\x0b\x0c\r", {}
    for conv_id in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0), t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv_id)
        seen, faults, turns = set(), [], sorted({t for _, t, _, _ in own if t is not None})
        for _, _, role, text in own:
            end = text.rstrip(space)
            faults.append(1 if not end else 2 if (role, text) in seen else 0 if end[-1] in ".!?" else 3)
            seen.add((role, text))
        cost, edits = cheapest([(f, o[2][:1]) for f, o in zip(faults, own, strict=True)], Costs(), 1)
        lines, i = [], 0
        for edit in edits:
            text = "" if edit == "I" else own[i][3]
            if edit == "K":
                lines.append(own[i][2] + ":" + text)
            elif edit != "D":
                placed = len(lines) - (1 if lines and lines[0][0] == "s" else 0)
                lines.append(("user:", "assistant:")[placed % 2] + text)
            i += edit != "I"
        initials = [o[2][:1] for o in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        out[conv_id] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (1, 5, "user", "Hi?"), (1, 6, "assistant", "No end"),
    (2, None, None, None), (2, None, "user", "Same turn."), (2, None, "user", "Same turn."), (2, 3, "assistant", "Tail. \t\n"),
    (None, 0, "user", "é\x00\U0001f600!"), (None, 1, "assistant", "Yes. "), (3, 0, "", ""), (4, 7, "assistant", "x" * 200_000 + "."),
    (5, 1, "user", "Tie b."), (5, 1, "user", "Tie a."), (5, 1, "assistant", "Tie."), (6, -3, "Studio", "Odd role."), (6, 9, "user", "One."),
]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(*r, "x", 1) for r in ODD], SCHEMA)
    want = plain(ODD)
    got = audit(rows)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {k: v[:-1] for k, v in want.items()}
    lines = {}
    for r in sorted(repaired(rows).collect(), key=lambda r: r.place):
        assert r.place == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {k: v[-1] for k, v in want.items() if v[-1]}


def test_given_conversations(spark, sf):
    """The query's rows over the whole table against the exhaustive search and the plain damage."""
    from zlib import crc32

    from pagemill.llm.catalog import op12_conversation_repair

    rows = duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
    hurt = []
    for c, t, role, text in rows:
        k = crc32(f"{c}:{t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        hurt += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, *_ in rows} | {k: v[:-1] for k, v in plain(hurt).items()}
    assert {r[0]: tuple(r)[1:] for r in op12_conversation_repair(spark, sf).collect()} == want


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert audit(empty).collect() == [] == audit(damaged(empty), empty).collect() == repaired(empty).collect()
    gone = spark.createDataFrame([(9, 1, "user", "x", "", 0)], SCHEMA)
    row = audit(gone.where("false"), gone).collect()
    assert [tuple(r) for r in row] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
