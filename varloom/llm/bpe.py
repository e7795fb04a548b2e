"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece one token is stored: the last token of that prefix's BPE encoding. It is found among the
vocabulary entries that end there (an automaton over the vocabulary gives them all in one sweep) as the only one that
may follow the stored token of the prefix before it. Whether one token may follow another is a property of the two
alone and is decided by undoing their merges. Following the back-pointers from the end of the piece gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ._common import arrow_map

#: Entries in each of the two generations of a worker's cache of encoded chunks. Results don't depend on it.
CACHE_ENTRIES = 200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class PrefixBPE:
    """Encoder and decoder for a tokenizer file of the kind: lower case, split on a pattern, byte alphabet, BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        if not self.suffix or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("not a BPE model with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(pattern)
        ascii_pattern = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace("[[", "[").replace("]]", "]")
        self.ascii_pieces = re.compile(ascii_pattern)
        self.bytes = byte_alphabet()
        # merges: rank by the merged token's place; a token's two halves; the merged token of two halves
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for n, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            t = vocab[a + b]
            if t in self.halves:
                raise ValueError("a token has two merges")
            self.rank[t], self.halves[t], self.joined[vocab[a], vocab[b]] = n, (vocab[a], vocab[b]), t
        self.may_follow: dict[int, bool] = {}
        self.stands: dict[int, bool] = {}
        self.ends: dict[str, int] = {}  # tokens with the word end, by their text
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if t in self.special or not self._stands(i):
                continue
            if t.endswith(self.suffix) and len(t) > len(self.suffix):
                self.ends[t[: -len(self.suffix)]] = i
            else:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.longest_end = max(map(len, self.ends))

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two tokens that it made of their own texts.

        Undo the later of the merges nearest the border, again and again. If, at some time of the true run, two tokens
        that touch the border had a merge earlier than the one that then hides them, BPE would have crossed the border.
        """
        rank, halves, joined = self.rank, self.halves, self.joined
        limit = len(rank) + 1.0  # merges before this may cross
        while True:
            both = joined.get((left, right))
            if both is not None and rank[both] < limit:
                return False
            r_left, r_right = rank.get(left, -1), rank.get(right, -1)
            if r_left < 0 and r_right < 0:
                return True
            if r_left > r_right:  # the left one was made last
                limit, left = r_left, halves[left][1]
            else:  # at equal rank the left one is made first, so the right one is undone first
                limit, right = r_right + 0.5, halves[right][0]

    def _stands(self, t: int) -> bool:
        """Whether BPE makes this one token of the token's own text."""
        ok = self.stands.get(t)
        if ok is None:
            h = self.halves.get(t)
            ok = self.stands[t] = h is None or (self._stands(h[0]) and self._stands(h[1]) and self._compatible_but(h[0], h[1], t))
        return ok

    def _compatible_but(self, left: int, right: int, whole: int) -> bool:
        """_compatible, were it not for the merge into whole."""
        key = (left, right)
        saved = self.joined.pop(key)
        try:
            return self._compatible(left, right)
        finally:
            self.joined[key] = saved

    def _follows(self, before: int, t: int) -> bool:
        if len(self.may_follow) > 1_000_000:
            self.may_follow.clear()
        ok = self.may_follow[before << 20 | t] = self._compatible(before, t)
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given in the byte alphabet."""
        whole = self.ends.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        last: list = [None] * n  # the stored token of each prefix short of the piece
        back = [0] * n
        follows = self.may_follow.get
        for at, (t, size) in self.automaton.iter(piece, 0, n - 1):
            end = at + 1
            if last[end] is None:
                start = end - size
                if start:
                    before = last[start]
                    ok = follows(before << 20 | t)
                    if ok is None:
                        ok = self._follows(before, t)
                    if not ok:
                        continue
                last[end] = t
                back[end] = start
        ends = self.ends
        for at in range(max(1, n - self.longest_end), n):
            t = ends.get(piece[at:])
            if t is not None:
                before = last[at]
                ok = follows(before << 20 | t)
                if ok is None:
                    ok = self._follows(before, t)
                if ok:
                    break
        else:
            raise ValueError(f"no token ends {piece!r}")
        ids = [t]
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return ids

    def _split(self, part: str) -> Iterator[str]:
        """Pieces of a text without white space and special tokens, in the byte alphabet."""
        if part.isascii() and part.isprintable():
            yield from self.ascii_pieces.findall(part.lower())
        else:
            part = unicodedata.normalize("NFC", part)
            part = "".join([c.lower() for c in part])  # letter by letter: no rule for a last sigma
            for p in self.pieces.findall(part):
                yield p if p.isascii() and p.isprintable() else "".join([self.bytes[b] for b in p.encode()])

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        ids: list[int] = []
        parts = self.special_split.split(text) if self.special_split and "<|" in text else (text,)
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for chunk in chunks_of(part):
                    for p in self._split(chunk):
                        ids += self.encode_piece(p)
        return ids

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.encode(t)).tobytes() for t in texts]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included. The file names no decoder, so tokens stand between spaces."""
        return " ".join([self.token[i] for i in ids])


_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to str.split(), not to the pattern
_SPACE = regex.compile(r"[\p{White_Space}]+")


def chunks_of(text: str) -> list[str]:
    """Maximal runs of what the pattern does not take for white space; no token reaches over their borders."""
    return text.split() if not _SEPARATORS.search(text) else [x for x in _SPACE.split(text) if x]


class Vocabulary:
    """ids of whole texts, each distinct chunk between ASCII white space encoded once in a batch and remembered.

    encode_many gives the ids of short texts as little-endian unsigned 32-bit integers. No token reaches over white
    space, so a text's ids are its chunks' in a row. Two shortcuts share entries: a letters-only chunk and its forms
    with a comma or full stop behind it, and (the normaliser lowers case) the forms of an ASCII chunk in other case.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self.encode_many, self.entries = encode_many, entries
        self.tails = dict(zip(",.", encode_many([",", "."])))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def of(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) > self.entries:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        keys, tails, todo = [], [], set()
        for c in chunks:
            tail = b""
            if c[-1:] in ",." and c[:-1].isalpha():
                tail = self.tails[c[-1]]
                c = c[:-1]
            if c.isascii() and "<|" not in c:
                c = c.lower()
            keys.append(c)
            tails.append(tail)
            if c not in known:
                if c in older:
                    known[c] = older[c]
                else:
                    todo.add(c)
        new = list(todo)
        known.update(zip(new, self.encode_many(new)))
        return [known[k] + t if t else known[k] for k, t in zip(keys, tails)]


def batches_of_chunks(texts: pa.Array, rows: int = 4000) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """For every `rows` texts (null: empty) the offsets of their chunks, the chunks as codes, and what the codes stand for."""
    for at in range(0, len(texts), rows):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.slice(at, rows).cast(pa.large_string()), ""))
        coded = pc.dictionary_encode(lists.flatten())
        offsets = lists.offsets.to_numpy()
        yield offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary.to_pylist()


def joined_ids(entries: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the coded chunks in a row, where each chunk's begin and the last one's end)."""
    flat = np.frombuffer(b"".join(entries), "<u4")
    size = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
    first = np.cumsum(size) - size
    n = size[codes]
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(at[-1], "<u4")
    for a in range(0, len(codes), 100_000):  # indices take more memory than ids
        b = min(len(codes), a + 100_000)
        out[at[a] : at[b]] = flat[np.repeat(first[codes[a:b]] - at[a:b], n[a:b]) + np.arange(at[a], at[b])]
    return out, at


_BY_PATH: dict[str, tuple[PrefixBPE, Vocabulary]] = {}


def bpe_round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    One row per input row: the id column, n_tokens, ids_sha256, decoded_sha256, and with ids=True also the ids
    (array<int>) and the decoded text. A null text counts as empty: no tokens, the digests of no bytes. Null ids and
    repeated rows stay as they are; other columns are ignored. Map-only: nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _BY_PATH:
            bpe = PrefixBPE(path)
            _BY_PATH[path] = bpe, Vocabulary(bpe.encode_many)
        bpe, vocabulary = _BY_PATH[path]
        for batch in batches:
            n, a, b, all_ids, all_text = [], [], [], [], []
            for offsets, codes, chunks in batches_of_chunks(batch.column(1)):
                entries = vocabulary.of(chunks)
                tokens, at = joined_ids(entries, codes)
                text = [bpe.decode(array("I", e)) for e in entries]
                listed = codes.tolist()
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = tokens[at[i] : at[j]]
                    decoded = " ".join([t for c in listed[i:j] if (t := text[c])])
                    n.append(len(own))
                    a.append(hashlib.sha256(own.tobytes()).hexdigest())
                    b.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        all_ids.append(own.astype(np.int32))
                        all_text.append(decoded)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    more = ", ids array<int>, decoded string" if ids else ""
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
