import hashlib
import itertools
import random
import zlib

import pytest

from scribemend.llm import dialogue

ROWS = "conv_id long, turn long, role string, text string"
ROLES = ["user", "assistant", "system", "tool", "", None]
TEXTS = ["a.", "b", " ", "", "What? ", "c!\n", None, "a.", "é…"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        said = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repair(rows):
    """Cheapest repair by one pass from the first row on that keeps the best (cost, audit, lines) of each state."""
    after = {0: "u", 1: "u", 2: "a", 3: "u"}
    place = {"u": 2, "a": 3}

    def better(best, state, new):
        if state not in best or new[:2] < best[state][:2]:
            best[state] = new

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, lines) in list(best.items()):
                role = {"u": "user", "a": "assistant"}[after[state]]
                better(best, place[after[state]], (cost + 5, audit + "I", [*lines, role + ":"]))
        return best

    best = {0: (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults(rows), strict=True):
        now = {}
        for state, (cost, audit, lines) in inserted(best).items():
            better(now, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            if role[:1] == after[state]:
                better(now, place[after[state]], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            if role[:1] == "s" and state == 0:
                better(now, 1, (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            due = {"u": "user", "a": "assistant"}[after[state]]
            better(now, place[after[state]], (cost + more + 1, audit + "R", [*lines, f"{due}:{text}"]))
        best = now
    return min((v for k, v in inserted(best).items() if k in (0, 3)), key=lambda v: v[:2])


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = damage([r for r in rows if r[0] == conv])
        found, turns = faults(own), [r[1] for r in own if r[1] is not None]
        first = [r[2][:1] for r in own]
        cost, audit, lines = repair(own)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[found.count(x) for x in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def all_edits(kinds):
    """Cheapest (cost, audit) over every way of editing the rows, three inserts at most."""
    best = None
    for letters in itertools.product("DKR", repeat=len(kinds)):
        if any(k in "bd" and x != "D" for k, x in zip(kinds, letters, strict=True)):
            continue
        for inserts in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(kinds) + 1), n) for n in range(4)):
            cost, audit, output = 5 * len(inserts), "", []
            for at in range(len(kinds) + 1):
                output += [("I", "")] * inserts.count(at)
                audit += "I" * inserts.count(at)
                if at < len(kinds):
                    audit += letters[at]
                    cost += {"D": 2, "K": 0, "R": 1}[letters[at]] + (5 if kinds[at].isupper() and letters[at] != "D" else 0)
                    if letters[at] != "D":
                        output.append((letters[at], kinds[at].lower()))
            want = ("s" if len(output) % 2 else "") + "ua" * (len(output) // 2)
            if want == "s" or any(x == "K" and own != due or x in "IR" and due == "s" for (x, own), due in zip(output, want, strict=True)):
                continue
            if best is None or (cost, audit) < best:
                best = (cost, audit)
    return best


def traced(kinds):
    found, state = dialogue.trace(kinds, dialogue.END, 0)
    audit = "".join(letters for letters, _ in found)
    while state in (1, 2):
        audit, state = audit + "I", dialogue.NEXT[state]
    return dialogue.vectors(kinds, dialogue.END)[0][0], audit


@pytest.mark.parametrize("n", range(4))
def test_every_way_of_editing(n):
    for kinds in itertools.product("suaxSUAXb", repeat=n):
        assert traced("".join(kinds)) == all_edits("".join(kinds))


def made(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(r.randint(0, longest)):
            rows.append((conv, r.choice([turn, turn, turn + 2, None]), r.choice(ROLES[:3] * 3 + ROLES), r.choice(TEXTS) if r.random() < 0.5 else f"t {turn}" + r.choice([".", "", "?"])))
    return rows + [(None, 1, "user", "x."), (None, None, None, None), *[r for r in rows if r[0] == 3]]


@pytest.mark.parametrize(("chunk_bits", "fan_bits"), [(0, 1), (2, 1), (6, 4)])
def test_like_a_plain_pass(llm, chunk_bits, fan_bits):
    rows = made(5, 25, 40)
    given = llm.createDataFrame([(*r, 1, "x") for r in rows], ROWS + ", cost int, name string")
    got = dialogue.repaired(dialogue.damaged(given), given, chunk_bits, fan_bits).collect()
    want = expected(rows)
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_speculative_chunks_are_run_again_until_they_agree(llm):
    """Truncated rows hand a vector on as it is, so that the fix-up passes have to carry it over all chunks."""
    rows = [(7, t, "user" if t % 2 else "assistant", f"no end {t}") for t in range(300)] + [(7, 300, "assistant", "end.")]
    given = llm.createDataFrame(rows, ROWS)
    turns = dialogue.placed(given)
    chunks, ran = dialogue.converged(dialogue.chunks_of(dialogue.kinds(turns), 2), 1)
    right = {r["chunk"]: r for r in chunks.collect()}
    assert ran[0] == len(right) >= 75 and 2 < len(ran) <= 9 and ran[1] > 0
    carried = dialogue.END
    for number in sorted(right, reverse=True):
        assert list(right[number]["right"]) == carried
        carried = dialogue.level(dialogue.vectors(right[number]["kinds"], carried)[0])
    want = expected(rows)
    assert [tuple(r)[1:] for r in dialogue.damaged_and_repaired(given).collect()] == list(want.values())


def test_no_rows(llm):
    none = llm.createDataFrame([], ROWS)
    assert dialogue.damaged_and_repaired(none).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = dialogue.damaged_and_repaired(llm.createDataFrame([(gone, 0, "user", "x")], ROWS)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
