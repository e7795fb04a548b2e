"""Global alignment with affine gaps: match 0, mismatch 1, gap 2 to open and 1 for each step."""

from __future__ import annotations

MISMATCH, OPEN, EXTEND = 1, 2, 1


def align(a: list, b: list) -> str:
    """The cheapest transcript of a into b: M equal, X different, D only in a, I only in b. Ties take M or X, then I, then D."""
    n, m = len(a), len(b)
    far = 10**9
    best = [[far] * (m + 1) for _ in range(n + 1)]
    only_b = [[far] * (m + 1) for _ in range(n + 1)]
    only_a = [[far] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if j:
                only_b[i][j] = min(best[i][j - 1] + OPEN + EXTEND, only_b[i][j - 1] + EXTEND)
            if i:
                only_a[i][j] = min(best[i - 1][j] + OPEN + EXTEND, only_a[i - 1][j] + EXTEND)
            if i and j:
                best[i][j] = best[i - 1][j - 1] + (a[i - 1] != b[j - 1]) * MISMATCH
            if i or j:
                best[i][j] = min(best[i][j], only_b[i][j], only_a[i][j])
    out, i, j, at = [], n, m, "best"
    while i or j:
        if at == "best":
            if i and j and best[i][j] == best[i - 1][j - 1] + (a[i - 1] != b[j - 1]) * MISMATCH:
                i, j = i - 1, j - 1
                out.append("M" if a[i] == b[j] else "X")
                continue
            at = "b" if j and best[i][j] == only_b[i][j] else "a"
        if at == "b":
            at = "best" if only_b[i][j] == best[i][j - 1] + OPEN + EXTEND else "b"
            j -= 1
            out.append("I")
        else:
            at = "best" if only_a[i][j] == best[i - 1][j] + OPEN + EXTEND else "a"
            i -= 1
            out.append("D")
    return "".join(reversed(out))


def cost(transcript: str) -> int:
    total, before = 0, ""
    for c in transcript:
        total += MISMATCH if c == "X" else EXTEND + OPEN * (c != before) if c in "ID" else 0
        before = c
    return total
