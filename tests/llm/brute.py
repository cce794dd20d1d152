"""Plain versions of what the operators compute, for small inputs."""

from collections import defaultdict


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    words = ascii_lower(text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def components_of(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def without_repeated_lines(rows, min_lines):
    """(id, text) in any order to {id: (lines, removed, kept text)}."""
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if text is None:
            out[i] = (0, 0, None)
            continue
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for p in range(len(full) - min_lines + 1):
            window = tuple(lines[k] for k in full[p : p + min_lines])
            if window in seen:
                gone.update(full[p : p + min_lines])
            seen.add(window)
        out[i] = (len(full), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def best_segmentation(unit, pieces, byte_score=-40_000_000):
    """Piece ids of the best score; of equal ones, the longer last piece, from the end on. pieces: text to (id, micro)."""
    best = [(0, 0, [])] + [None] * len(unit)
    for end in range(1, len(unit) + 1):
        options = []
        for start in range(end):
            if unit[start:end] in pieces:
                id_, micro = pieces[unit[start:end]]
                options.append((best[start][0] + micro, -start, best[start][2] + [id_]))
        raw = unit[end - 1].encode()
        options.append((best[end - 1][0] + len(raw) * byte_score, -(end - 1), best[end - 1][2] + [f"<0x{b:02X}>" for b in raw]))
        best[end] = max(options, key=lambda o: o[:2])
    return best[-1][2]


def grouped(rows):
    out = defaultdict(list)
    for k, v in rows:
        out[k].append(v)
    return out


def periodic_runs_of(words, least):
    """(start, end, smallest period) of every run, by start and period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
            i = i if i > start else i + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))
