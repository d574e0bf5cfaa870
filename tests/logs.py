"""Small logs, a random log, and the fold of a log in plain Python."""

import datetime
import random

LOG = (
    "ns_name string, segment_id bigint, seg_offset bigint, lsn bigint, hlc bigint, crc32_checksum bigint, operation_type string, txn_state string, "
    "entry_type string, txn_id binary, prev_txn_wal_index binary, entries array<struct<entry_key:binary,entry_value:binary,cells:map<string,binary>>>, ingested_at timestamp_ntz"
)


def rec(lsn, op="Insert", state="None", kind="KV", entries=(), txn=None, ns="n", at=None):
    """A log record; entries are (key, value) or (key, value, cells)."""
    made = None if entries is None else [(e[0], e[1], e[2] if len(e) > 2 else None) for e in entries]
    at = datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=lsn if at is None else at)
    return (ns, lsn // 100 + 1, (lsn % 100) * 64, lsn, 1735689600000 + lsn, 0, op, state, kind, txn, None, made, at)


def kv(lsn, key, value, **more):
    return rec(lsn, entries=[(key, value)], **more)


def txn(name, kind, *steps, op="Insert", ns="n"):
    """Records of one transaction from (state letter, lsn, entries)."""
    out = []
    for letter, lsn, *entries in steps:
        state = {"B": "Begin", "P": "Prepare", "C": "Commit"}[letter]
        key = entries[0][0] if entries and kind == "Chunked" else None
        out.append(rec(lsn, "NoOperation" if letter == "B" else op, state, kind, [] if letter == "B" else entries if letter == "P" else [(key, None)], name, ns))
    return out


def fold(records):
    """{(ns, type, key, cell): (lsn, entry_no)} of the live values, and {(ns, key): bytes} of the large objects."""
    seen = {}
    for r in records:
        seen[r[0], r[3]] = r
    commits = {(r[0], r[9]): r for r in sorted(seen.values(), key=lambda r: r[3]) if r[7] == "Commit"}
    changes = []
    for r in seen.values():
        op, order = r[6], r[3]
        if r[7] == "Prepare":
            c = commits.get((r[0], r[9]))
            if c is None or c[3] < r[3]:
                continue
            op, order = c[6], c[3]
        elif r[7] != "None" or r[8] not in ("KV", "Row"):
            continue
        if op in ("Insert", "Delete", "DeleteRowByKey"):
            changes += [((order, r[3], i), r[0], r[8], op, e) for i, e in enumerate(r[11] or []) if e[0] is not None]
    live, objects = {}, {}
    for order, ns, kind, op, (key, value, cells) in sorted(changes, key=lambda c: c[0]):
        place = order[1:]
        if kind == "KV":
            live.pop((ns, "KV", key, ""), None)
            if op == "Insert":
                live[ns, "KV", key, ""] = place
        elif kind == "Row":
            if op == "DeleteRowByKey":
                live = {k: v for k, v in live.items() if not (k[0] == ns and k[1] == "Row" and k[2] == key)}
            for name in cells or {}:
                live.pop((ns, "Row", key, name), None)
                if op == "Insert":
                    live[ns, "Row", key, name] = place
        else:
            if objects.get((ns, key), (None,))[0] != order[0]:
                objects[ns, key] = (order[0], b"")
            objects[ns, key] = (order[0], objects[ns, key][1] + (value or b""))
            live[ns, "Chunked", key, ""] = place
    return live, {k: v[1] for k, v in objects.items()}


def random_log(seed, n=120):
    """A dirty log: transactions that interleave, abort or delete, repeats, disorder, nulls and empty values."""
    r = random.Random(seed)
    out, open_txns = [], []
    key = lambda: r.choice([b"a", b"b", b"hot", b"hot", b"\xfe\x00", b""])
    value = lambda: r.choice([None, b"", b"v", b"w" * 40])
    cells = lambda: {r.choice("xyz"): value() for _ in range(r.randint(1, 3))}
    for lsn in range(1, n):
        ns, what = r.choice(["n", "n", "m"]), r.random()
        if what < 0.3:
            out.append(rec(lsn, r.choice(["Insert", "Insert", "Delete"]), entries=[(key(), value()) for _ in range(r.randint(0, 3))], ns=ns))
        elif what < 0.5:
            op = r.choice(["Insert", "Insert", "Delete", "DeleteRowByKey"])
            out.append(rec(lsn, op, kind="Row", entries=[(key(), None, None if op == "DeleteRowByKey" else cells())], ns=ns))
        elif what < 0.62:
            kind = r.choice(["KV", "Row", "Chunked"])
            t = (b"t%d" % lsn, kind, ns, "Insert" if kind == "Chunked" else r.choice(["Insert", "Insert", "Delete"]), key())
            open_txns.append(t)
            out.append(rec(lsn, "NoOperation", "Begin", kind, [], t[0], ns))
        elif open_txns and what < 0.85:
            t = r.choice(open_txns)
            entry = {"KV": (key(), value()), "Row": (key(), None, cells()), "Chunked": (t[4], b"%d;" % lsn)}[t[1]]
            out.append(rec(lsn, t[3], "Prepare", t[1], [entry], t[0], t[2]))
        elif open_txns and what < 0.95:
            t = open_txns.pop(r.randrange(len(open_txns)))
            out.append(rec(lsn, t[3], "Commit", t[1], [(t[4] if t[1] == "Chunked" else None, None)], t[0], t[2]))
        else:
            out.append(rec(lsn, "RaftInternal", entries=r.choice([[], None]), ns=ns))
    out += r.sample(out, n // 10)
    r.shuffle(out)
    return out
