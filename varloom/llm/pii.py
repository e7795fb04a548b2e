"""Personal data: fixed patterns, and candidates that boosted trees select.

Generators propose every span that may be personal data, overlapping ones too: whatever stands around an @, groups of
digits joined by single separators and their parts, colon-separated addresses, codes of letters and digits. Trees fitted
by gradient boosting score a candidate by its format and by what stands around it. Scores are calibrated on documents
held out from the fit, and each generator's threshold is the least at which held-out precision suffices.

The fit needs labelled candidates. They come from a bounded sample of the documents, into whose copies made-up personal
data and look-alikes (versions, prices, dates, order numbers) are planted: a candidate is positive if it is exactly a
planted item or a span of a fixed pattern, and negative otherwise.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, written

#: Kinds in the order that breaks ties: those of the fixed patterns, then the generators'.
BASE_KINDS = ("email", "ip", "card", "phone")
FOUND_KINDS = ("mail_like", "number_like", "address_like", "code_like")
KINDS = BASE_KINDS + FOUND_KINDS
#: Bounds of the fit: documents of the sample, candidates of theirs, and planted items a document.
FIT_DOCS, FIT_CANDIDATES, PLANTED = 2000, 40_000, 8
MIN_PRECISION = 0.98  # held-out precision that a generator's threshold must reach
AROUND = 40  # code points before a candidate in which words count

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from their @, so that runs without one cost nothing: the part before is the run of its
    letters up to the @, from where the last match ended at the earliest."""
    out, last, run = [], 0, None
    at = text.find("@")
    runs = _LOCAL.finditer(text) if at >= 0 else iter(())
    while at >= 0:
        while run is None or run.end() < at:
            run = next(runs, None)
            if run is None:
                return out
        if run.end() == at and max(run.start(), last) < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", max(run.start(), last), m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def _ips(text: str) -> list[Span]:
    """Every four parts in turn of a run of digits and dots: what the pattern matches leftmost."""
    out = []
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) of the fixed patterns, leftmost and not overlapping within a kind; offsets in code points."""
    spans = _emails(text) + _ips(text)
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- candidates

_NUMBER = re.compile(r"[0-9]+")
_JOINTS = set(" ().-/")
_COLONS = re.compile(r"[0-9A-Fa-f:]{4,}")
_CODE = re.compile(r"[A-Z]{1,2}[0-9]{2}(?:\x20?[A-Z0-9]){4,30}")
_AT = re.compile(r"@|\x20?[\[(]at[\])]\x20?")
_LEFT, _RIGHT = re.compile(r"[\w.%+-]+\Z"), re.compile(r"[\w-]+(?:\.[\w-]+)*")


def candidates(text: str) -> list[Span]:
    """What may be personal data, as (generator, start, end). A text gives a number of them in proportion to its length."""
    out: list[Span] = []
    for m in _AT.finditer(text):
        left, right = _LEFT.search(text[max(0, m.start() - 64) : m.start()]), _RIGHT.match(text, m.end(), m.end() + 255)
        if left and right:
            out.append(("mail_like", m.start() - len(left.group()), right.end()))
    group: list[tuple[int, int]] = []
    for m in [*_NUMBER.finditer(text), None]:
        if group and (m is None or m.start() - group[-1][1] > 2 or not _JOINTS.issuperset(text[group[-1][1] : m.start()])):
            out += _windows(text, group)
            group = []
        if m is not None:
            group.append(m.span())
    for m in _COLONS.finditer(text):
        if m.group().count(":") >= 2 and m.end() - m.start() <= 45:
            out.append(("address_like", *m.span()))
    out += [("code_like", *m.span()) for m in _CODE.finditer(text)]
    return out


def _windows(text: str, group: list[tuple[int, int]]) -> Iterator[Span]:
    """Up to six neighbouring numbers of 7 to 19 digits together; with the bracket or plus before them."""
    for i in range(len(group)):
        digits = 0
        for j in range(i, min(i + 6, len(group))):
            digits += group[j][1] - group[j][0]
            if digits > 19:
                break
            if digits >= 7:
                a = group[i][0]
                yield ("number_like", a, group[j][1])
                if a and text[a - 1] in "(+":
                    yield ("number_like", a - 1, group[j][1])


#: Words before a candidate that speak for kinds of personal data or against them. Fixed values.
CUES = {
    "mail": "e-?mail|mail|write to|reach",
    "phone": "phone|telephone|tel|call|fax|mobile|cell|contact|whatsapp",
    "card": "card|visa|mastercard|credit|debit|amex",
    "identity": "ssn|social security|passport|national id|tax id|licen[cs]e no|driver",
    "bank": "iban|account|bank|routing|swift",
    "birth": "born|birth|dob|birthday",
    "network": "ip|host|server|client|mac|login from|address",
    "other": "version|release|build|order|invoice|isbn|page|section|total|price|ticket|item|sku|token|hash|sha|commit|serial|chapter|figure|table|width|height|doi|since|until|updated|year|score|km|kg",
}
_CUES = re.compile("|".join(rf"(?P<{k}>(?<![^\W_])(?:{v})(?![^\W_]))" for k, v in CUES.items()), re.I)
_CUE_NAMES = list(CUES)


def _mod97(s: str) -> bool:
    """Whether an account number in international form has the right check digits."""
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _like_date(parts: list[str]) -> bool:
    if len(parts) != 3 or sorted(map(len, parts)) not in ([2, 2, 4], [1, 2, 4], [1, 1, 4], [2, 2, 2]):
        return False
    year = [p for p in parts if len(p) == 4]
    return all(1 <= int(p) <= 31 or p in year for p in parts) and (not year or 1900 <= int(year[0]) <= 2100)


def describe(text: str, span: Span) -> list[float]:
    """Features of a candidate: what it is made of, checks, neighbours, words before it."""
    kind, a, b = span
    s = text[a:b]
    parts = _NUMBER.findall(s) or [""]
    digits = "".join(parts)
    joints = [c for c in s if not c.isalnum()]
    letters = sum(c.isalpha() for c in s)
    before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    two_before, two_after = text[max(0, a - 2) : a], text[b : b + 2]
    last: dict[str, int] = {}
    for m in _CUES.finditer(text[max(0, a - AROUND) : a]):
        last[m.lastgroup] = m.end()
    reach = min(a, AROUND)
    right = s.rpartition("@")[2] if "@" in s else s
    lens = [len(p) for p in parts]
    return [
        FOUND_KINDS.index(kind), b - a, len(digits), letters, len(joints), len(set(joints)), len(parts), lens[0], lens[-1], max(lens), min(lens),
        len(set(digits)), s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count(":"), s.count("("), s.count("@"), right.count("."), len(right.rpartition(".")[2]) if "." in right else 0,
        s[0] == "+", s[0] == "(", s[0] == "0", 12 <= len(digits) <= 19 and luhn(digits), kind == "code_like" and _mod97(s), lens == [3, 2, 4], lens[-3:] == [3, 3, 4], lens == [4, 4, 4, 4],
        len(lens) == 4 and max(lens) <= 3 and all(int(p) <= 255 for p in parts), _like_date(parts), s.count(":") == 5 and [len(x) for x in s.split(":")] == [2] * 6, s.count(":") == 7 or "::" in s,
        before.isalnum(), after.isalnum(), before in ".,-/:_", after in "-/:_%", before in "#$€£=\"'", two_after[:1] in ".," and two_after[1:].isdigit(), two_before[1:] in (".", ",", "-", "/") and two_before[:1].isdigit(),
        *[reach - last[k] + 1 if k in last else 99 for k in _CUE_NAMES],
    ]


# ---- boosted trees


@dataclass
class Trees:
    """Regression trees of depth 3 over binned features: nodes 1 to 7 split, leaves follow. Goes right where bin > cut."""

    edges: list[np.ndarray]
    feature: np.ndarray  # trees x 8
    cut: np.ndarray
    value: np.ndarray  # trees x 8 leaves
    bias: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.uint8) if len(x) else np.zeros((0, len(self.edges)), np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        z = np.full(len(x), self.bias)
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.ones(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + (b[rows, f[node]] > c[node])
            z += v[node - 8]
        return z


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 80, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Gradient boosting of the logistic loss with second-order gains, over histograms of binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    t = Trees(edges, np.zeros((rounds, 8), np.int64), np.zeros((rounds, 8), np.int64), np.zeros((rounds, 8)), float(np.log(share / (1 - share))))
    b = t.binned(x).astype(np.int64)
    n, d = b.shape
    flat = b + np.arange(d) * bins
    z = np.full(n, t.bias)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.ones(n, np.int64)
        for level in range(3):
            first, width = 1 << level, 1 << level
            at = ((node - first)[:, None] * (d * bins) + flat).ravel()
            shape = (width, d, bins)
            sg = np.bincount(at, np.repeat(g, d), width * d * bins).reshape(shape).cumsum(2)
            sh = np.bincount(at, np.repeat(h, d), width * d * bins).reshape(shape).cumsum(2)
            tg, th = sg[:, :, -1:], sh[:, :, -1:]
            gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
            gain[(sh < least) | (th - sh < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            t.feature[r, first : 2 * first], t.cut[r, first : 2 * first] = best // bins, np.where(worth, best % bins, bins)
            node = 2 * node + (b[np.arange(n), t.feature[r, node]] > t.cut[r, node])
        leaf = node - 8
        t.value[r] = -rate * np.bincount(leaf, g, 8) / (np.bincount(leaf, h, 8) + ridge)
        z += t.value[r][leaf]
    return t


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (scores, rising probabilities) of the best rising fit of y to z, by pooling neighbours that fall."""
    scores, place = np.unique(z, return_inverse=True)
    count, total = np.bincount(place), np.bincount(place, y)
    at, value, weight = [], [], []
    for s, n, t in zip(scores, count, total):
        at.append(s)
        value.append(t / n)
        weight.append(n)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, w, _ = value.pop(), weight.pop(), at.pop()
            value[-1] = (value[-1] * weight[-1] + v * w) / (weight[-1] + w)
            weight[-1] += w
    return np.array(at), np.array(value)


@dataclass
class Model:
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray] | None
    thresholds: tuple[float, ...]  # by generator; above 1: none of its candidates is taken

    def probability(self, x: np.ndarray) -> np.ndarray:
        at, value = self.steps
        i = np.searchsorted(at, self.trees.raw(x), side="right") - 1
        return np.where(i < 0, 0.0, value[np.maximum(i, 0)])


NO_MODEL = Model(None, None, (2.0,) * len(FOUND_KINDS))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, *, min_precision: float = MIN_PRECISION, least: int = 10) -> Model:
    """Trees from the rows that are not held out, calibration and thresholds from those that are.

    A generator's threshold is the least calibrated probability from which on its held-out candidates have at least
    min_precision, and `least` of them are positive; without one its candidates are never taken.
    """
    if not len(y) or y[~held].min(initial=1) == y[~held].max(initial=0) or not held.any():
        return NO_MODEL
    trees = boost(x[~held], y[~held])
    steps = isotonic(trees.raw(x[held]), y[held])
    m = Model(trees, steps, ())
    p, yh, kind = m.probability(x[held]), y[held], x[held, 0]
    limits = []
    for k in range(len(FOUND_KINDS)):
        own = np.argsort(-p[kind == k], kind="stable")
        pk, yk = p[kind == k][own], yh[kind == k][own]
        good = np.cumsum(yk)
        ends = np.flatnonzero(np.append(pk[1:] != pk[:-1], True)) if len(pk) else np.zeros(0, int)
        right = [i for i in ends if good[i] >= min_precision * (i + 1) and good[i] >= least and pk[i] > 0.5]
        limits.append(float(pk[right[-1]]) if right else 2.0)
    return Model(trees, steps, tuple(limits))


# ---- what the fit learns from


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + _digits(rng, 14)
    return next(body + c for c in "0123456789" if luhn(body + c))


def _iban(rng: random.Random) -> str:
    land, body = rng.choice(["DE", "FR", "GB", "ES", "NL", "IT"]), _digits(rng, 18)
    check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    return f"{land}{check:02d}{body}"


def _name(rng: random.Random) -> str:
    return "".join(rng.choice(["an", "be", "co", "da", "el", "fi", "go", "hu", "in", "jo", "ka", "li", "mo"]) for _ in range(rng.randrange(2, 4)))


def planted(rng: random.Random) -> tuple[str, str, bool]:
    """(words before, item, whether it is personal data) of a made-up item or look-alike."""
    d = lambda n: _digits(rng, n)
    grouped = lambda s, c: c.join(s[i : i + 4] for i in range(0, len(s), 4))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    sep = rng.choice([": ", " ", " is ", " - ", "="])
    cue = lambda *words: rng.choice(words) + sep
    bare = lambda *words: cue(*words) if rng.random() < 0.6 else ""
    date = f"{rng.randrange(1, 29):02d}{(c := rng.choice('./-'))}{rng.randrange(1, 13):02d}{c}{rng.randrange(1930, 2024)}"
    right = [
        lambda: (bare("email", "Mail", "write to"), f"{_name(rng)}{rng.choice(['.', '_', ''])}{_name(rng)}{rng.choice(['(at)', ' [at] ', '[at]', ' (at) '])}{_name(rng)}.{rng.choice(['com', 'org', 'de', 'fr'])}"),
        lambda: (bare("e-mail", "contact"), f"{rng.choice(['jürgen', 'andré', 'niño', 'françois'])}.{_name(rng)}@{_name(rng)}.{rng.choice(['com', 'net', 'de'])}"),
        lambda: (bare("phone", "call", "Tel", "mobile"), rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])),
        lambda: (cue("phone", "Tel", "fax", "call"), rng.choice([f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(7)}", f"0{d(3)}/{d(7)}"])),
        lambda: (bare("card", "Visa", "credit card"), grouped(_card(rng), rng.choice([".", "/"]))),
        lambda: (bare("SSN", "social security"), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (bare("IBAN", "account", "bank"), rng.choice([_iban(rng), grouped(_iban(rng), " ")])),
        lambda: (cue("born", "DOB", "date of birth", "birthday"), date),
        lambda: (cue("account", "account no", "bank account", "routing"), d(rng.randrange(8, 12))),
        lambda: (cue("passport", "passport no"), rng.choice("CFGHKXYZ") + d(8)),
        lambda: (bare("IP", "host", "server"), ":".join(hexes(4) for _ in range(8))),
        lambda: (bare("MAC", "client", "address"), ":".join(hexes(2) for _ in range(6))),
    ]
    wrong = [
        lambda: (cue("version", "release", "build"), f"{d(1)}.{d(2)}.{d(rng.randrange(2, 6))}.{d(rng.randrange(1, 4))}"),
        lambda: (bare("total", "price"), f"{rng.choice(['$', ''])}{rng.randrange(1, 999)},{d(3)},{d(3)}.{d(2)}"),
        lambda: (rng.choice(["", "on ", "updated ", "since ", "until "]), date),
        lambda: (bare("order", "invoice", "ticket", "item"), rng.choice(["#", "", "No. "]) + d(rng.randrange(7, 13))),
        lambda: (bare("ISBN"), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"),
        lambda: (rng.choice(["at ", "from ", ""]), f"{rng.randrange(24):02d}:{d(2)}:{d(2)}"),
        lambda: (bare("token", "hash", "commit"), hexes(rng.choice([24, 32, 40]))),
        lambda: (bare("token", "key", "serial"), rng.choice(['"', ""]) + hexes(rng.choice([16, 24, 32, 40])).upper()),
        lambda: ("", "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rng.randrange(8, 30)))),
        lambda: (bare("position"), f"{rng.randrange(-80, 80)}.{d(5)}, {rng.randrange(-180, 180)}.{d(5)}"),
        lambda: ("", f"{rng.randrange(1900, 1999)}-{rng.randrange(2000, 2030)}"),
        lambda: (bare("page", "section", "table"), f"{d(3)}-{d(4)}"),
        lambda: ("", d(rng.randrange(12, 20))),
        lambda: ("", " ".join(d(rng.randrange(1, 5)) for _ in range(rng.randrange(2, 8)))),
        lambda: (bare("serial", "sku"), rng.choice("ABCD") + rng.choice(["", "X"]) + d(rng.randrange(6, 12))),
        lambda: (bare("score", "width"), f"0.{d(rng.randrange(7, 12))}"),
        lambda: ("", f"{_name(rng)}@{rng.randrange(1, 9)}{rng.choice(['x', 'pm', ''])}"),
        lambda: ("", f"{d(3)}/{d(3)}/{d(3)}"),
    ]
    good = rng.random() < 0.5
    before, item = rng.choice(right if good else wrong)()
    return before, item, good


def plant(text: str, seed: int, n: int = PLANTED) -> tuple[str, set[tuple[int, int]]]:
    """text with items put in at blanks, and the spans of those that are personal data."""
    rng = random.Random(seed)
    blanks = [i for i, c in enumerate(text) if c == " "]
    places = sorted(rng.sample(blanks, min(n, len(blanks))))
    out, spans, at, length = [], set(), 0, 0
    for p in places:
        before, item, good = planted(rng)
        out += [text[at : p + 1], before, item, rng.choice([" ", " ", ", ", ". "])]
        length += p + 1 - at + len(before)
        if good:
            spans.add((length, length + len(item)))
        length += len(item) + len(out[-1])
        at = p + 1
    return "".join(out) + text[at:], spans


def _labelled(docs: DataFrame) -> DataFrame:
    """(held, y, x) of every candidate in the planted copies of (id as text, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ys, xs = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(key.encode())
                full, spans = plant(text.as_py() or "", seed)
                spans |= {(a, b) for _, a, b in base_spans(full)}
                for c in candidates(full):
                    held.append(seed % 3 == 0)
                    ys.append(float((c[1], c[2]) in spans))
                    xs.append(describe(full, c))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.bool_()), pa.array(ys, pa.float64()), pa.array([list(map(float, x)) for x in xs], pa.list_(pa.float64()))], names=["held", "y", "x"])

    return arrow_map(docs, run, "held boolean, y double, x array<double>")


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, fit_candidates: int = FIT_CANDIDATES) -> Model:
    """A model from at most fit_docs documents, drawn by hash of their ids, and at most fit_candidates candidates of theirs.

    Documents with a null id or text are not drawn. Whole texts are read where they lie; the driver gets candidates'
    features and labels, never a text. Without a document nothing is ever taken beyond the fixed patterns.
    """
    text = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    draw = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 40))
    total = docs.count()
    ids = text.where(draw < int(min(1.0, 1.3 * fit_docs / max(total, 1)) * (1 << 40))).select("id", draw.alias("d")).distinct().orderBy("d", "id").limit(fit_docs)
    drawn = [r["id"] for r in ids.collect()]  # names of the sample's documents, bounded by fit_docs
    if not drawn:
        return NO_MODEL
    own = written(_labelled(text.where(F.col("id").isin(drawn))), "candidates")
    by = F.xxhash64("x", "y")
    n = own.count()
    rows = own.where(F.pmod(by, F.lit(1 << 40)) < int(min(1.0, 1.3 * fit_candidates / max(n, 1)) * (1 << 40))).orderBy(by).limit(fit_candidates).toArrow().combine_chunks()
    if not rows.num_rows:
        return NO_MODEL
    x = np.array(rows.column("x").to_pylist(), float)
    return fit(x, rows.column("y").to_numpy(), rows.column("held").to_numpy(zero_copy_only=False))


# ---- the operator


def select(spans: list[Span], found: list[Span], p: np.ndarray, thresholds: tuple[float, ...]) -> list[tuple[str, int, int, float | None]]:
    """The base spans, and of the candidates at or above their threshold the likeliest that overlap neither base spans nor
    each other; of equally likely ones the longer, then the earlier."""
    taken: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out: list[tuple[str, int, int, float | None]] = [(*s, None) for s in spans]
    good = [i for i, c in enumerate(found) if p[i] >= thresholds[FOUND_KINDS.index(c[0])]]
    for i in sorted(good, key=lambda i: (-p[i], found[i][1] - found[i][2], found[i][1])):
        kind, a, b = found[i]
        k = bisect_left(taken, (b, -1))
        if k == 0 or taken[k - 1][1] <= a:
            taken.insert(k, (a, b))
            out.append((kind, a, b, float(p[i])))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(texts: list[str], model: Model, at_once: int = 20_000) -> Iterator[list[tuple[str, int, int, float | None]]]:
    """Spans of each text; candidates of several texts are scored together, at_once of them or those of one text."""
    waiting: list[tuple[list[Span], list[Span]]] = []
    rows: list[list[float]] = []

    def out() -> Iterator[list]:
        p = model.probability(np.array(rows, float)) if rows else np.zeros(0)
        at = 0
        for spans, found in waiting:
            yield select(spans, found, p[at : at + len(found)], model.thresholds)
            at += len(found)

    for text in texts:
        spans = base_spans(text)
        found = candidates(text) if model.trees is not None else []
        if spans:  # those that overlap a base span are never taken
            ends = np.array([b for _, _, b in spans])
            starts = np.array([a for _, a, _ in spans])
            found = [c for c in found if not ((starts < c[2]) & (ends > c[1])).any()] if len(spans) * len(found) < 1_000_000 else found
        waiting.append((spans, found))
        rows += [describe(text, c) for c in found]
        if len(rows) >= at_once:
            yield from out()
            waiting, rows = [], []
    yield from out()


def redact(text: str, spans: list[tuple[str, int, int, float | None]]) -> str:
    """text with every span replaced by its kind in brackets; of overlapping ones the first names all."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,probability:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def find_personal(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Personal data of every whole text.

    One row per input row: the id column, the columns in keep, spans (array of kind, start, end, probability; sorted by
    start, then kind; the probability is null for fixed patterns), and with redacted=True the text with its spans
    replaced (null where the text is null). A null or empty text has no spans. Null ids and repeated rows stay as they
    are; other columns are ignored. An empty table gives no rows. Map-only; a text's time grows with its length.
    """
    used = docs.select(id_col, text_col, *[c for c in keep if c not in (id_col, text_col)])
    send = [c for c in used.columns if c in (id_col, *keep)]
    fields = ", ".join(f"`{c}` {used.schema[c].dataType.simpleString()}" for c in send)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                spans, clean = [], []
                for x, found in zip(batch.column(1), scan((x.as_py() or "" for x in batch.column(1)), model)):
                    spans.append([{"kind": k, "start": a, "end": b, "probability": p} for k, a, b, p in found])
                    if redacted:
                        clean.append(redact(x.as_py(), found) if x.is_valid else None)
                cols, names = [*(batch.column(batch.schema.get_field_index(c)) for c in send), pa.array(spans, _SPANS)], [*send, "spans"]
                if redacted:
                    cols.append(pa.array(clean, pa.string()))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(used, run, f"{fields}, spans {SPANS}" + (", redacted string" if redacted else ""))
