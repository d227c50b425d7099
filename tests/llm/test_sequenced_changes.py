"""The change applier against the rules row by row: gaps, ties, repeated and late rows, nulls, one hot client, no rows."""

import collections
import datetime
import random
import zlib

import pytest

from weftgraph.llm import sequenced_changes as sc

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, n string"


def changes(seed, n=900):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        client = r.choice([1, 1, 1, 2, 3, 4, 5, None, -1])
        day = r.randrange(0, 130)
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=r.randrange(24))
        seq = max(0, day // 2 + r.randrange(-2, 3)) * 10
        city, balance = r.choice([None, "A", "B", "C"]), r.choice([None, -0.125, 1.005, 2.5, round(r.uniform(-9, 9), 2)])
        op = r.choice(["I", "U", "U", "U", "D", None, "X"])
        rows.append((i, client, r.choice([seq] * 20 + [None]), op, r.choice([at] * 30 + [None]), "s", "g", city, balance, "own"))
    rows += rows[:40]
    rows += [(n, 7, 1, "I", datetime.datetime(2023, 5, 1), "s", "g", "old", 1.0, "own"), (n + 2, 7, 2, "U", datetime.datetime(2031, 5, 1), "s", "g", "new", 2.0, "own")]
    rows += [(None, 8, 1, "I", at, "s", "g", "no id", 1.0, "own")]
    # One change_id with several contents on one day.
    rows += [(n + 4, 9, 1, "U", datetime.datetime(2024, 2, 1), "s", "g", c, None, "own") for c in ("b", None, "a")]
    r.shuffle(rows)
    return rows


def prepared(rows):
    """What ``numbered`` has to give, plainly."""
    rows = set(rows)
    ranks = {}
    for c in {x[1] for x in rows}:
        seqs = sorted({x[2] for x in rows if x[1] == c}, key=lambda s: (s is not None, s or 0))
        ranks |= {(c, s): k + 1 for k, s in enumerate(seqs)}
    out = []
    for change_id, client, seq, op, at, _, _, city, balance, _ in rows:
        h = None if change_id is None else zlib.crc32(str(change_id).encode())
        if at is None or h is None or h % 11 == 0:
            continue
        day = (at.date() - datetime.date(1970, 1, 1)).days + 5 * (h % 4)
        batch = max(1, min(10, 1 + (day - 19723) * 10 // 160))
        cents = None if balance is None else int((100 * balance + 0.5) // 1)
        out.append((client, ranks[client, seq], day, change_id, op, city, cents, batch))
    return out


@pytest.mark.parametrize("seed, fresh", [(1, 20_000), (2, 3)])
def test_equals_the_rules(spark, monkeypatch, seed, fresh):
    monkeypatch.setattr(sc, "FRESH", fresh)
    monkeypatch.setattr(sc, "SLOT_ROWS", 120)
    rows = changes(seed, 900 if seed == 1 else 300)
    want_in = prepared(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert collections.Counter(map(tuple, sc.numbered(df).collect())) == collections.Counter(want_in)
    got = collections.Counter(map(tuple, sc.apply_changes(df).collect()))
    want = collections.Counter(sc.brute(want_in))
    assert got == want
    kinds = collections.Counter((x[2], x[4] > 0) for x in want)
    assert min(kinds["applied", True], kinds["applied", False], kinds["rejected", False]) > 20


def test_no_rows(spark):
    got = sc.apply_changes(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
    assert got.collect() == []
