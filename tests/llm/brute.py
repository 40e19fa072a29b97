"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }
            if good[kind]:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def without_repeats(rows, width=200):
    raws = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(b[p : p + width] for _, b in raws for p in range(len(b) - width + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if starts[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def linked(codes, distance):
    """Smallest index reachable from each code."""
    label = list(range(len(codes)))
    near = [[j for j in range(len(codes)) if (codes[i] ^ codes[j]).bit_count() <= distance] for i in range(len(codes))]
    moved = True
    while moved:
        moved = False
        for i, around in enumerate(near):
            low = min(label[j] for j in around)
            if low < label[i]:
                label[i], moved = low, True
    return label


def water(sizes, weights, share, epochs):
    """Targets by repeated clamping and resharing."""
    total, capped = share * sum(sizes), {}
    while True:
        rest = total - sum(capped.values())
        open_ = [i for i in range(len(sizes)) if i not in capped]
        weight = sum(weights[i] for i in open_)
        target = {i: rest * weights[i] / weight for i in open_}
        over = [i for i in open_ if target[i] > epochs * sizes[i] + 1e-9]
        if not over:
            return [capped.get(i, target.get(i)) for i in range(len(sizes))]
        capped |= {i: float(epochs * sizes[i]) for i in over}


def without_repeated_lines(rows):
    """(id, text) with later occurrences of three-line windows removed."""
    seen, gone = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        gone[i] = set()
        for k in range(len(lines) - 2):
            window = "\n".join(lines[k : k + 3])
            if WORD.search(window):
                if window in seen:
                    gone[i] |= {k, k + 1, k + 2}
                seen.add(window)
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) for i, t in rows}
