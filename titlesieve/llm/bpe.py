"""Byte-level BPE over a public rank file: encoding with a rank queue, decoding by table.

The queue keeps one bucket a merge rank, holding the places of linked-list nodes whose pair
with the next node has that rank. A three-level bitmap over the ranks finds the lowest filled bucket with
three find-first-set steps, and entries overtaken by later merges are skipped when they come up. A merge
costs the same however long the pre-token is, apart from the heap that keeps a bucket's places in order.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REMEMBERED = 200_000  # pre-tokens whose ids a worker keeps; the store is emptied when full
_LONG = 256  # longer pre-tokens are not kept
_SLICE = 1_000_000  # characters of texts that are cut and merged at once, or one longer text
_ROWS = 256  # rows whose results are held at once
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _members(category: str) -> str:
    """Body of a character class: the characters of a category up to U+FFFF."""
    if category == r"\s":
        return "".join(map(re.escape, _WHITE))
    of, out, first = regex.compile(category), [], None
    for c in range(0x10001):
        inside = c < 0x10000 and not 0xD800 <= c < 0xE000 and of.match(chr(c)) is not None
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"{re.escape(chr(first))}-{re.escape(chr(c - 1))}")
            first = None
    return "".join(out)


def splitters(pattern: str) -> tuple[re.Pattern, regex.Pattern]:
    """The splitting pattern twice: spelled out for the faster library, which holds for texts up to
    U+FFFF, and for any text. White space is what Unicode defines, whatever a library takes \\s for."""
    body = {c: _members(c) for c in (r"\p{L}", r"\p{N}", r"\s")}

    def spelled(known: dict[str, str]) -> str:
        out, inside, i = "", False, 0
        while i < len(pattern):
            c = next((k for k in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(k, i)), pattern[i:i + 2] if pattern[i] == "\\" else pattern[i])
            i += len(c)
            inside = (inside or c == "[") and c != "]"
            if c == r"\S":
                out += "[^" + known[r"\s"] + "]"
            elif c in known:
                out += known[c] if inside else "[" + known[c] + "]"
            else:
                out += c
        return out

    return re.compile(spelled(body)), regex.compile(spelled({r"\s": body[r"\s"]}))


class RankQueue:
    """Places by merge rank; the lowest filled rank is found with three find-first-set steps."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def fill(self, rank: int, places: list[int]) -> None:
        """Opens the bucket of ``rank``; further places are appended to it."""
        self.buckets[rank] = places
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def lowest(self) -> tuple[int, list[int]]:
        """Takes out the lowest filled bucket, its places from left to right."""
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        places = self.buckets.pop(rank)
        places.sort()
        return rank, places


class Tokenizer:
    """Encodes and decodes by one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.uint32)
        self.double = np.array([self.ranks.get(bytes([i >> 8, i & 255]), -1) for i in range(65536)], dtype=np.int32)
        self.plain, self.any = splitters(pattern)
        self.known: dict[str, bytes] = {}

    def merge(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of non-empty pre-tokens. They lie side by side in one linked list without pairs
        across their borders, so that a rank is looked for once for all of them."""
        buf, ends = b"".join(raws), np.cumsum([len(r) for r in raws])
        n, get, queue = len(buf), self.ranks.get, RankQueue(self.size)
        data = np.frombuffer(buf, dtype=np.uint8)
        token = self.single[data]
        ids = token.tolist()
        border = bytearray(n + 1)  # 1: a pre-token starts here
        for e in ends.tolist():
            border[e] = 1
        border[0] = 1
        ranks = np.full(n, -1, dtype=np.int32)
        ranks[:-1] = self.double[data[:-1].astype(np.int32) << 8 | data[1:]]
        ranks[ends - 1] = -1
        pair = ranks.tolist()  # rank of the pair that starts here, -1: none
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0):]
        cuts = [0, *(np.flatnonzero(np.diff(ranks[order])) + 1).tolist(), len(order)] if len(order) else []
        order = order.tolist()
        for i, j in zip(cuts, cuts[1:]):
            queue.fill(pair[order[i]], order[i:j])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1") * n
        borders, buckets, fill = ends.tolist(), queue.buckets, queue.fill
        while queue.top:
            rank, bucket = queue.lowest()
            wait, put_off = -1, []
            for at in bucket:
                if pair[at] != rank:
                    continue  # stale
                if at < wait:
                    put_off.append(at)
                    continue
                gone = after[at]
                right = after[gone]
                after[at], before[right] = right, at
                pair[gone], alive[gone], ids[at] = -1, 0, rank
                if border[right]:
                    pair[at] = lowest = -1
                else:
                    pair[at] = lowest = new = get(buf[at:after[right]], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(at)
                        else:
                            fill(new, [at])
                if not border[at]:
                    left = before[at]
                    pair[left] = new = get(buf[left:right], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            fill(new, [left])
                        if new < rank:
                            lowest = new
                if 0 <= lowest < rank:  # comes first within this pre-token; the others do not mind
                    wait = borders[bisect_right(borders, at)]
            if put_off:
                fill(rank, put_off + buckets.get(rank, []))
        live = np.frombuffer(alive, dtype=np.uint8).astype(bool)
        packed, upto = np.array(ids, dtype="<u4")[live].tobytes(), [0, *(4 * np.cumsum(live)[ends - 1]).tolist()]
        return [packed[a:b] for a, b in zip(upto, upto[1:])]

    def learn(self, pieces: set[str]) -> list[str]:
        """Makes ``pieces`` known; returns those too long to be kept."""
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        rest, raws = [], []
        for p in new:
            raw = p.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                rest.append(p)
                raws.append(raw)
            else:
                self.known[p] = whole.to_bytes(4, "little")
        if raws:
            self.known.update(zip(rest, self.merge(raws)))
        return [p for p in rest if len(p) > _LONG]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for group in _slices(texts):
            cut = [(self.plain if not t or max(t) <= "\uffff" else self.any).findall(t) for t in group]
            long = self.learn(set(chain.from_iterable(cut)))
            out += [b"".join(map(self.known.__getitem__, c)) for c in cut]
            for p in long:
                del self.known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _slices(texts: list[str]):
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > _SLICE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def _mapped(df: DataFrame, column: str, out: str, convert) -> DataFrame:
    """``df`` with a binary column ``out`` of what ``convert()`` makes of the values of a batch."""
    source = df.columns.index(column)

    def run(batches):
        change = convert()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                values = pa.array(change(part.column(source).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: the token ids of each whole text as packed little-endian unsigned 32-bit
    integers. Null and empty texts have no ids; other columns pass through, one already named ``out`` is
    replaced; rows are independent, so repeated ones repeat."""

    def convert():
        t = tokenizer(path, pattern)
        return lambda values: t.encode([v or "" for v in values])

    return _mapped(docs.drop(out), text, out, convert)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the bytes that the ids stand for; null ids give no bytes. An id that the
    rank file lacks is an error."""

    def convert():
        t = tokenizer(path, pattern)
        return lambda values: [t.decode(v or b"") for v in values]

    return _mapped(encoded.drop(out), ids, out, convert)


def op4(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract of the query: token count and digests of the ids and of the decoded bytes."""
    encoded = encode(docs.select("doc_id", "text"), path, pattern).drop("text")
    return decode(encoded, path, pattern).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
