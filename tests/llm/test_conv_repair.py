import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from paddyframe.llm import conv_repair, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def hurt(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def told_faults(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        kept = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def every_script(rows):
    """Lightest (cost, audit) over all edit scripts with at most two inserts in a gap."""
    gaps = ["", "u", "a", "ua", "au"]
    edits = [["D"] + [e for e in "KUA" if f not in ("blank", "duplicate")] for f in told_faults(rows)]
    best = None
    for script in product(*[x for e in edits for x in (gaps, e)], gaps):
        cost, audit, read = 0, "", ""
        for k, e in enumerate(script):
            if k % 2 == 0:
                cost, audit, read = cost + 3 * len(e), audit + "I" * len(e), read + e
            elif e == "D":
                cost, audit = cost + 4, audit + "D"
            else:
                cost += 3 * (e != "K") + 3 * (told_faults(rows)[k // 2] == "truncated")
                audit, read = audit + ("K" if e == "K" else "R"), read + (rows[k // 2][2][:1] if e == "K" else e.lower())
        if re.fullmatch("(s?(ua)+)?", read) and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


def slow(rows):
    """A dynamic programme over rows and states, from the last row to the first."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults = told_faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    after = {"": (0, "", ()), "a": (0, "", ()), "s": None, "u": None}

    def with_inserts(best):
        for _ in range(3):
            for q in ("", "s", "u", "a"):
                for r in ("user", "assistant"):
                    to = step.get((q, r[0]))
                    if to and best[to] is not None:
                        c, a, left = best[to]
                        best[q] = min(x for x in (best[q], (c + 3, "I" + a, ((r, ""),) + left)) if x)
        return best

    after = with_inserts(after)
    for (_, _, role, text), fault in reversed(list(zip(rows, faults))):
        here, add = {}, 3 if fault == "truncated" else 0
        for q in ("", "s", "u", "a"):
            options = [] if after[q] is None else [(after[q][0] + 4, "D" + after[q][1], after[q][2])]
            if fault not in ("blank", "duplicate"):
                for letter, r, c in (("K", role, add), ("R", "user", 3 + add), ("R", "assistant", 3 + add)):
                    to = step.get((q, r[:1]))
                    if to and after[to] is not None:
                        options.append((after[to][0] + c, letter + after[to][1], ((r, text),) + after[to][2]))
            here[q] = min(options) if options else None
        after = with_inserts(here)
    cost, audit, left = after[""]
    initials = [r[2][:1] for r in rows]
    turns = {r[1] for r in rows if r[1] is not None}
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha)


def odd_rows(n, seed, convs):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2"]
    texts = ["Hello there.", "Yes!", "what", "why?", "", " \t\n", None, "a\n.", "end.  ", "über?", "x" * 300 + "!"]
    out = []
    for _ in range(n):
        c = rng.choice(convs)
        out.append((c, rng.choice([None, *range(12)]) if rng.random() < .3 else rng.randint(0, 400), rng.choice(roles),
                    rng.choice(texts) if rng.random() < .5 else f"t{rng.randint(0, 99)}{rng.choice(['.', ''])}"))
    return out


def found(spark, rows):
    r = conv_repair.repair(spark.createDataFrame([(*x, 1) for x in rows], SCHEMA + ", cost int"))
    sha = {x.conv_id: x.sha for x in r.digests().collect()}
    lines = {}
    for x in sorted(r.rows().collect(), key=lambda x: (x.part, x.seq, x.pos)):
        lines.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    out = {}
    for x in r.conversations().collect():
        assert x.conv_id not in out and hashlib.sha256("\n".join(lines.get(x.conv_id, [])).encode()).hexdigest() == sha[x.conv_id]
        out[x.conv_id] = (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, sha[x.conv_id])
    return out


def by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_a_dynamic_programme(spark, seed):
    rows = odd_rows(700, seed, [None, *range(120)])
    assert found(spark, rows) == {c: slow(v) for c, v in by_conv(rows).items()}


def test_long_conversations_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(conv_repair, "SEGMENT_ROWS", 7)
    rows = odd_rows(900, 9, [1, 1, 1, 2, None, 3]) + [(7, t, "system", f"s{t}.") for t in range(90)] + [(8, 1, "user", "same.")] * 50
    rows += [(9, t, "user", "") for t in range(60)] + [(10, 0, "assistant", "x" * 100_000 + ".")] * 2
    assert found(spark, rows) == {c: slow(v) for c, v in by_conv(rows).items()}


def test_dynamic_programme_against_every_edit_script():
    rng = random.Random(4)
    for n in [0, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3]:
        rows = [("c", t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b!", "c", "", f"{t}?"])) for t in range(n)]
        assert every_script(rows) == slow(rows)[5:7]


def test_whole_query(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += odd_rows(300, 2, [None, 10**6, *range(-40, 0)])
    empty = next(c for c in range(10**7, 10**8) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((empty, 1, "user", "Gone."))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_structure_repair(spark, str(tmp_path)).collect()}
    left = by_conv(hurt(rows))
    assert got == {c: slow(left.get(c, [])) for c in {r[0] for r in rows}}
    assert got[empty] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert found(spark, []) == {}
    assert conv_repair.damage(spark.createDataFrame([], SCHEMA)).count() == 0
