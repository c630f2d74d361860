"""Plain models that several tests share."""

import re


def brute_cut(rows, length, words, whole):
    """(doc_id, text) without the passages that a row with a smaller doc_id has too; words cut in part stay."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None:
                first[b[i : i + length]] = min(first.get(b[i : i + length], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            f = first.get(b[i : i + length])
            if f is not None and (d is None or f < d):
                gone[i : i + length] = b"x" * length
        kept, at = [], 0
        for m in re.finditer(b"x+", bytes(gone)):
            a, z = m.span()
            run = b[a:z]
            if z - a < whole and len(run.split()) <= words:
                continue
            gap = [i for i in range(a, z) if b[i : i + 1].isspace()]
            if gap:
                part_before = a > 0 and not b[a - 1 : a].isspace() and not b[a : a + 1].isspace()
                part_behind = z < len(b) and not b[z - 1 : z].isspace() and not b[z : z + 1].isspace()
                x, y = gap[0] if part_before else a, gap[-1] + 1 if part_behind else z
                a, z = (x, y) if x < y else (a, z)
            kept.append(b[at:a])
            at = z
        kept.append(b[at:])
        text = ""
        for x in (x.decode(errors="ignore") for x in kept):
            text += (" " if text and x and not text[-1].isspace() and not x[0].isspace() else "") + x
        if text or not b:
            out.append((d, text))
    return out
