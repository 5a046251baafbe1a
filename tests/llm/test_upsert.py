"""Copy-on-write upsert against a plain Python version: whole files, their order, ties, nulls, merges and odd tables."""

import glob
import hashlib
import math
import random
import zlib

import pyarrow.parquet as pq
import pytest

from lexiloom.llm import upsert

CLIENTS = "client_id long, master_id long, source string, city string, segment string, balance double, key_slice string, file_number string"
CHANGES = "change_id long, client_id long, seq long, op string, source string, segment string, city string, balance double, base string"


def crc(value):
    return zlib.crc32(str(value).encode())


def least(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def brute(clients, changes, sets=(2, 4, 3, 7)):
    """Files of (rows, rewritten) after the upsert; clients and changes are tuples in the order of the schemas above."""
    most = 1 + len(clients) // 1000
    kept = {}
    for row in clients:
        if row[0] is not None and crc(row[0]) % 7 > 3 and (row[0] not in kept or least(row) < least(kept[row[0]])):
            kept[row[0]] = row
    rows = [kept[k] for k in sorted(kept)]
    start = [rows[i : i + most] for i in range(0, len(rows), most)]
    if not start:
        return [], most
    firsts = [f[0][0] for f in start]
    home = lambda k: max([i for i, f in enumerate(firsts) if f <= k], default=0)
    won = {}
    for c in changes:
        if c[1] is not None and (c[1] not in won or least((c[2], c[0], c[3], *c[4:8])) > least((won[c[1]][2], won[c[1]][0], won[c[1]][3], *won[c[1]][4:8]))):
            won[c[1]] = c
    now = [{r[0]: r for r in f} for f in start]
    for k, c in won.items():
        i = home(k)
        h = crc(firsts[i]) % 16
        if h > 7:
            continue
        if c[3] == "D" or (c[0] is not None and crc(c[0]) % 8 < h):
            now[i].pop(k, None)
        else:
            row = list(now[i].get(k, (k,) + (None,) * (len(clients[0]) - 1)))
            row[2], row[4], row[3], row[5] = c[4], c[5], c[6], c[7]
            now[i][k] = tuple(row)
    files = []
    for old, new in zip(start, now):
        new = [new[k] for k in sorted(new)]
        if new == old:
            files.append((old, False))
            continue
        parts = math.ceil(len(new) / most)
        at = 0
        for p in range(parts):
            size = len(new) // parts + (p < len(new) % parts)
            files.append((new[at : at + size], True))
            at += size
    out = []
    for rows, new in files:
        if new and out and out[-1][1] and len(out[-1][0]) + len(rows) <= most:
            out[-1] = (out[-1][0] + rows, True)
        else:
            out.append((rows, new))
    return out, most


def check(spark, clients, changes):
    want, most = brute(clients, changes)
    table = upsert.upsert_clients(upsert.clients_table(spark.createDataFrame(clients, CLIENTS)), spark.createDataFrame(changes, CHANGES))
    assert table.most == most
    got = sorted(upsert.file_digests(table).collect(), key=lambda r: r.first_id)
    assert len(got) == len(want) == len(glob.glob(f"{table.folder.removeprefix('file:')}/*.parquet")) == len(glob.glob(f"{table.folder.removeprefix('file:')}/*"))
    text = lambda r: "|".join(x or "" for x in (r[2], r[4], r[3]))
    for g, (rows, new) in zip(got, want):
        assert (g.first_id, g.n_rows, g.rewritten) == (rows[0][0], len(rows), new)
        assert g.cents == sum(math.floor(100 * r[5] + 0.5) for r in rows if r[5] is not None) and g.rows_crc == sum(crc(text(r)) for r in rows)
        assert g.ids_sha256 == hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
        stored = pq.ParquetFile(g.path.removeprefix("file://").removeprefix("file:")).read()
        assert ",".join(stored.column_names) == g.columns == ",".join(c.split()[0] for c in CLIENTS.split(", "))
        assert [tuple(r.values()) for r in stored.to_pylist()] == rows
    return want


def random_rows(rnd, n, changes, spread):
    word = lambda: rnd.choice(["a", "b", "ü", "", None])
    money = lambda: rnd.choice([None, 0.0, -1.005, 2.675, round(rnd.uniform(-99, 99), 2)])
    clients = [(i * 3, i, word(), word(), word(), money(), "x", None) for i in range(n)]
    rows = []
    for i in range(changes):
        k = rnd.choice([7, rnd.randrange(-50, 3 * n + spread), 3 * rnd.randrange(max(n, 1)), None])
        rows.append((rnd.choice([i, None]) if i % 9 == 0 else i, k, rnd.choice([1, 2, 3, None]), rnd.choice("IUUUD"), word(), word(), word(), money(), "x"))
    return clients, rows + rows[:20]


@pytest.mark.parametrize("n, changes, spread", [(400, 300, 20), (3500, 2000, 3000), (2500, 60, 10), (6000, 9000, 9000)])
def test_against_plain_python(spark, n, changes, spread):
    clients, rows = random_rows(random.Random(n), n, changes, spread)
    want = check(spark, clients, rows)
    assert any(new for _, new in want) and any(not new for _, new in want)


def test_all_inserts_behind_the_last_key_and_hot_keys(spark, monkeypatch):
    """The last home takes a thousand new keys, in several files and slices; one key has most of the changes."""
    monkeypatch.setattr(upsert, "SLICES", 16)
    clients, _ = random_rows(random.Random(5), 5000, 0, 0)
    last = max(c[0] for c in clients)
    rows = [(i, last + 5 + i, 1, "I", "n", None, "c", 1.0, "x") for i in range(3000)] + [(9000 + i, 9, i, "U", "z", "s", "c", float(i), "x") for i in range(3000)]
    check(spark, clients, rows)


def test_odd_tables(spark):
    clients, rows = random_rows(random.Random(6), 30, 40, 5)
    check(spark, [*clients, *clients, (None, 1, "a", "b", "c", 1.0, "x", "y"), (12, 0, "other", None, None, None, None, None)], rows)
    check(spark, clients, [])
    assert upsert.digest(spark.createDataFrame([], CLIENTS), spark.createDataFrame(rows, CHANGES)).count() == 0
    every = [(1000 + i, c[0], 9, "D", None, None, None, None, "x") for i, c in enumerate(clients)]
    check(spark, clients, every)


def test_cut_joins_only_neighbours_that_fit():
    assert upsert.cut([(3, True), (4, True), (2, True), (0, True), (1, True), (5, False), (1, True)], 10) == (
        [(3, 0, 0, 1), (4, 0, 0, 1), (2, 0, 0, 1), (0, 0, -1, -1), (1, 0, 0, 1), (0, 0, -1, -1), (1, 0, 1, 2)], 2,
    )
    assert upsert.cut([(3, True), (25, True), (2, True)], 10) == ([(3, 0, 0, 1), (8, 1, 1, 2), (2, 0, 3, 4)], 4)
