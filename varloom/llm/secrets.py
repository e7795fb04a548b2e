"""Secret scans: fixed patterns, and strings near sensitive words that a primed zstandard cannot shorten."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ._common import arrow_map

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order that breaks ties between spans that start together.
KINDS = ("assign", "access", "hex", "novel")
#: Words that make strings near them on their line sensitive. Fixed values.
SENSITIVE = re.compile(
    r"passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|signature|session[_-]?id|client[_-]?id",
    re.I | re.A,
)
_RUN = re.compile(r"[A-Za-z0-9+/_=~-]+", re.A)
#: Names that code uses. Together with the text around a candidate they are what compression may draw on. Fixed values.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key access_token refresh_token private_key public_key client_id "
    "client_secret authorization authenticate authentication bearer credential credentials session_id signature username user_name "
    "database_url connection_string environment configuration settings default example placeholder changeme undefined null none true "
    "false return import export function class struct public private protected static const final async await string integer boolean "
    "double float object array list dict map vector request response header headers content-type application/json charset utf-8 "
    "get set put post delete update insert select where from table column index primary key value values name type http https www "
    "localhost example.com .org .net user admin root test production development staging version license copyright abcdefghijklmnop"
    "qrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 00000000 ffffffff 11111111 deadbeef lorem ipsum dolor sit amet"
)
AROUND = 512  # code points before and after a candidate that compression may draw on
SHARED = 16  # characters of a candidate that count as a copy
REACH = 96  # code points between a sensitive word and a string of its line that it makes sensitive, on either side
MIN_NOVELTY = 0.95
MIN_CHARS = 16  # shorter strings are not tried: natural words cost as many bytes a character as random letters there


def alphabet_bits(s: str) -> float:
    """Bits of a random character of the alphabet (hexadecimal, or the classes of characters) that s is written in."""
    if not s.strip("0123456789"):
        return math.log2(10)
    if not s.strip("0123456789abcdef") or not s.strip("0123456789ABCDEF"):
        return 4.0
    classes = ((26, str.islower), (26, str.isupper), (10, str.isdigit), (6, lambda x: not x.isalnum()))
    return math.log2(max(2, sum(n for n, has in classes if any(map(has, s)))))


def _starts(found: list[tuple[int, int]]) -> list[int]:
    return [a for a, _ in found]


class Scanner:
    """Finds spans (kind, start, end, novelty) in one text; offsets in code points, end exclusive.

    Its time grows with the text's length: every run of characters is cut into candidates once, each candidate is
    compressed once, after a bounded context.
    """

    def __init__(self, identifiers: str = IDENTIFIERS, min_novelty: float = MIN_NOVELTY, min_chars: int = MIN_CHARS):
        self.min_novelty, self.min_chars = min_novelty, min_chars
        self.packer = zstandard.ZstdCompressor(
            level=3,
            dict_data=zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )

    def novelty(self, around: str, candidate: str) -> float:
        """Marginal compressed bytes of candidate after the dictionary and the text around it, as a share of what random
        characters of its alphabet need. About 1 and more: incompressible."""
        base = around.encode()
        more = len(self.packer.compress(base + candidate.encode())) - len(self.packer.compress(base))
        return more / (len(candidate) * alphabet_bits(candidate) / 8)

    def context(self, text: str, a: int, b: int) -> str:
        """The text around text[a:b] without copies of it or of 16 or more characters of it."""
        s = text[a:b]
        sides = []
        for side in (text[max(0, a - AROUND) : a], text[b : b + AROUND]):
            i = 0
            while i + SHARED <= len(s):
                n = SHARED
                if s[i : i + n] not in side:
                    i += 1
                    continue
                while i + n < len(s) and s[i : i + n + 1] in side:
                    n += 1
                side = side.replace(s[i : i + n], " ")  # 16 characters less, so few times a side
            sides.append(side)
        return sides[0] + sides[1]

    def base(self, text: str) -> list[tuple[str, int, int, float | None]]:
        spans: list[tuple[str, int, int, float | None]] = [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
        if "AKIA" in text:
            spans += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
        return spans + [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """Strings of min_chars characters or more with a sensitive word near them, in order.

        Runs of the characters that keys are made of, cut where sensitive words stand in them.
        """
        words = [m.span() for m in SENSITIVE.finditer(text)]
        if not words:
            return []
        begins, ends = _starts(words), [b for _, b in words]
        found = []
        for run in _RUN.finditer(text):
            at, stop = run.span()
            if stop - at < self.min_chars:
                continue
            for a, b in [*words[bisect_left(begins, at) : bisect_left(begins, stop)], (stop, stop)]:
                if a - at >= self.min_chars and self._near(text, at, a, begins, ends):
                    found.append((at, a))
                at = max(at, min(b, stop))
        return found

    def _near(self, text: str, a: int, b: int, begins: list[int], ends: list[int]) -> bool:
        """Whether the sensitive word next before or after text[a:b] stands on its line within reach."""
        k = bisect_right(ends, a) - 1
        if k >= 0 and a - ends[k] < REACH and text.find("\n", ends[k], a) < 0:
            return True
        k = bisect_left(begins, b)
        return k < len(begins) and begins[k] - b < REACH and text.find("\n", b, begins[k]) < 0

    def novel(self, text: str, taken: list[tuple[str, int, int, float | None]]) -> list[tuple[str, int, int, float | None]]:
        """Incompressible strings in a sensitive context that no base span overlaps, at every place where they stand."""
        blocks: list[list[int]] = []  # what base spans cover
        for _, x, y, _ in sorted(taken, key=lambda t: t[1]):
            if blocks and x <= blocks[-1][1]:
                blocks[-1][1] = max(blocks[-1][1], y)
            else:
                blocks.append([x, y])
        block_ends = [y for _, y in blocks]

        def free(a: int, b: int) -> bool:
            k = bisect_right(block_ends, a)
            return k == len(blocks) or blocks[k][0] >= b

        known: dict[str, float] = {}
        for a, b in self.candidates(text):
            s = text[a:b]
            if s not in known and free(a, b):
                n = self.novelty(self.context(text, a, b), s)
                if n >= self.min_novelty:
                    known[s] = n
        if not known:
            return []
        places = ahocorasick.Automaton()
        for s, n in known.items():
            places.add_word(s, (len(s), n))
        places.make_automaton()
        spans = [("novel", end + 1 - size, end + 1, n) for end, (size, n) in places.iter(text)]
        found, last = [], -1
        for x in sorted(spans, key=lambda x: (x[1], -x[2])):  # of those that hold one another the outer one
            if x[2] > last and free(x[1], x[2]):
                found.append(x)
                last = x[2]
        return found

    def scan(self, text: str) -> list[tuple[str, int, int, float | None]]:
        spans = self.base(text)
        spans += self.novel(text, spans)
        return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[tuple[str, int, int, float | None]], mark: str = "[SECRET]") -> str:
    """text with every span, overlapping ones together, replaced by mark."""
    out, at = [], 0
    for _, a, b, _ in sorted(spans, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,novelty:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_novelty: float = MIN_NOVELTY, min_chars: int = MIN_CHARS, identifiers: str = IDENTIFIERS, redacted: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Secrets of every whole text.

    One row per input row: the id column, the columns in keep, spans (array of kind, start, end, novelty; sorted by
    start, then kind), and with redacted=True the text with its spans replaced (null where the text is null). A null or
    empty text has no spans. Strings of under min_chars characters are found by the fixed patterns alone. Null ids and repeated rows stay as they are; other columns are ignored. Map-only.
    """
    used = docs.select(id_col, text_col, *[c for c in keep if c not in (id_col, text_col)])
    send = [c for c in used.columns if c in (id_col, *keep)]
    fields = ", ".join(f"`{c}` {used.schema[c].dataType.simpleString()}" for c in send)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(identifiers, min_novelty, min_chars)
        for batch in batches:
            spans, clean = [], []
            for x in batch.column(1):
                text = x.as_py()
                found = scanner.scan(text) if text else []
                spans.append([{"kind": k, "start": a, "end": b, "novelty": n} for k, a, b, n in found])
                if redacted:
                    clean.append(redact(text, found) if found else text)
            cols, names = [*(batch.column(batch.schema.get_field_index(c)) for c in send), pa.array(spans, _SPANS)], [*send, "spans"]
            if redacted:
                cols.append(pa.array(clean, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(used, run, f"{fields}, spans {SPANS}" + (", redacted string" if redacted else ""))
