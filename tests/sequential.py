"""A sequential replayer: one change after the other over a dict. Independent of Spark."""

import random


def apply(log, table=None):
    """``log``: (order, op, key, old_key, cells) with cells {column: (kind, value)}.
    Returns the rows by key and the number of changes without effect."""
    rows, anomalies = dict(table or {}), 0
    for _, op, key, old, cells in sorted(log, key=lambda c: c[0]):
        if op == "I":
            anomalies += key in rows
            rows[key] = {c: v for c, (_, v) in cells.items()}
        elif op == "D":
            if rows.pop(key, None) is None:
                anomalies += 1
        elif op == "T":
            rows.clear()
        else:
            source = key if old is None else old
            row = rows.get(source)
            if row is None:
                anomalies += 1
                continue
            new = {c: (row[c] if kind == "u" else v) for c, (kind, v) in cells.items()}
            if old is not None:
                del rows[old]
            rows[key] = new
    return rows, anomalies


def random_log(seed, steps, keys=12, moves=True, start=1):
    """Valid history in the mix of 25 % inserts, 50 % updates, 25 % deletes."""
    rng = random.Random(seed)
    live, log = set(), []
    for pos in range(start, start + steps):
        roll = rng.random()
        free = [k for k in range(keys) if k not in live]
        sent = {"a": ("t", f"a{pos}"), "b": ("n", None) if rng.random() < 0.3 else ("t", f"b{pos}")}
        if (roll < 0.25 or not live) and free:
            key = rng.choice(free)
            live.add(key)
            log.append((pos, "I", key, None, sent))
        elif roll < 0.75 and live:
            key = rng.choice(sorted(live))
            cells = {c: (("u", None) if rng.random() < 0.5 else v) for c, v in sent.items()}
            if moves and free and rng.random() < 0.4:
                new = rng.choice(free)
                live.remove(key)
                live.add(new)
                log.append((pos, "U", new, key, cells))
            else:
                log.append((pos, "U", key, None, cells))
        elif live:
            key = rng.choice(sorted(live))
            live.remove(key)
            log.append((pos, "D", key, None, {c: (None, None) for c in sent}))
    return log
