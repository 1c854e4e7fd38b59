"""Conversation repair against a plain shortest-path search over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from habitlake.llm import conversations as C

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("phase", T.StringType()), T.StructField("gone", T.StringType()), T.StructField("fault", T.StringType())])
SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def plain_repair(rows):
    """(cost, audit, rows) by trying, state by state, every edit; the least (cost, audit) per state."""
    best = {0: (0, "", ())}  # state of the pattern -> cost, audit, rows
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def offer(to, q, c, audit, kept):
        if q not in to or (c, audit) < to[q][:2]:
            to[q] = (c, audit, kept)

    def with_inserts(states):
        for _ in range(4):
            for q, (c, audit, kept) in list(states.items()):
                for who in ("user", "assistant"):
                    if (q, who[0]) in step:
                        offer(states, step[q, who[0]], c + 3, audit + "I", kept + ((who, ""),))
        return states
    for role, text, fault in rows:
        with_inserts(best)
        to = {}
        for q, (c, audit, kept) in best.items():
            offer(to, q, c + 4, audit + "D", kept)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if (q, role[:1]) in step:
                offer(to, step[q, role[:1]], c + more, audit + "K", kept + ((role, text),))
            for who in ("user", "assistant"):
                if (q, who[0]) in step:
                    offer(to, step[q, who[0]], c + more + 3, audit + "R", kept + ((who, text),))
        best = to
    with_inserts(best)
    return min(v for q, v in best.items() if q in (0, 3))


def plain_report(rows, damage=True):
    ids = list(dict.fromkeys(r[0] for r in rows))
    rows = plain_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faulty = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(SPACES)
            fault = "blank" if not bare.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, kept = plain_repair(faulty)
        count = lambda f: sum(x[2] == f for x in faulty)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_rows(df):
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(9)
    rows = []
    for conv in [None, *range(150)]:
        for i in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv, rng.choice([None, i, i, i + 3, 2]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "ubi", "été"]),
                         rng.choice([None, "", " \n\x0b", "Yes.", "Yes.", "What?\n", "no end", "a\nb! ", ".", "tail\xa0", "中文。", "Well!\t"]), "x", None, "y"))
    rows += [(7000, t, ["user", "assistant", "system"][t % 5 % 3], f"text {t % 170}" + ".!? "[t % 4], None, None, None) for t in range(400)]  # one long conversation
    rows += [(8000, None, "user", "x" * 300000 + ".", None, None, None), (8000, None, "assistant", "y.", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_report_real_and_odd(spark, odd):
    for df in (spark.read.parquet(f"{SF}/conversations.parquet"), odd):
        rows = plain_rows(df)
        assert got(C.report(C.damaged(df))) == plain_report(rows)
        assert got(C.report(C.intact(df))) == plain_report(rows, damage=False)


def test_repaired_rows_carry_the_digest(odd):
    rows = {}
    for r in C.repaired(C.damaged(odd)).collect():
        rows.setdefault(r["conv_id"], []).append((r["pos"], f"{r['role']}:{r['text']}", r["role"][0], r["edit"]))
    for r in C.report(C.damaged(odd)).collect():
        mine = sorted(rows.get(r["conv_id"], []))
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(m[1] for m in mine).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(m[2] for m in mine))
        assert "".join(m[3] for m in mine) == r["audit"].replace("D", "")


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(C.report(C.damaged(none))) == [] and C.repaired(C.intact(none)).count() == 0


def test_search_equals_the_plain_one_and_tries_few_bounds(monkeypatch):
    rng, bounds = random.Random(2), []
    within = C._within
    monkeypatch.setattr(C, "_within", lambda *a: bounds.append(a[2]) or within(*a))
    for _ in range(3000):
        kinds = [(rng.choice("suax"), rng.choice(["blank", "duplicate", "truncated", None, None, None])) for _ in range(rng.randint(0, 12))]
        codes = bytes(" sua".find(w) * (w in "sua") | (8 if f in ("blank", "duplicate") else 16 if f else 0) for w, f in kinds)
        cost, audit, _ = plain_repair([(w, "", f) for w, f in kinds])
        assert C.repair(codes) == (cost, audit), kinds
    assert len(bounds) < 2 * 3000
    bounds.clear()
    codes = bytes(rng.choice([1, 2, 3, 2, 3, 0, 10, 18, 19]) for _ in range(20000))
    cost, audit = C.repair(codes)
    assert len(bounds) <= 4 and len(audit.replace("I", "")) == 20000


def test_estimate_is_never_too_high():
    rng = random.Random(4)
    for _ in range(500):
        kinds = [(rng.choice("suax"), rng.choice(["blank", "truncated", None, None])) for _ in range(rng.randint(0, 8))]
        codes = bytes(" sua".find(w) * (w in "sua") | (8 if f == "blank" else 16 if f else 0) for w, f in kinds)
        assert C.estimates(codes)[0, 0] <= plain_repair([(w, "", f) for w, f in kinds])[0]
