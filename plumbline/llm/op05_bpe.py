"""Byte-level BPE as a reduction over a tree of text pieces.

A piece of text stands for its token ids. Halves are encoded apart and joined: only a window around the cut is encoded anew,
and it grows until the tokens outside are proved to stay. Two proofs are used.

* A cut between two characters of different classes (letters, numbers, white space, the rest) cannot lie inside a match of
  the pattern, whatever stands around it; the two exceptions, a blank before a word and an apostrophe before letters, are
  left out. Matches before such a cut depend on one character after it at most, matches after it on nothing before it.
* Inside one long match, a sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of
  theirs. So it is enough that the window's ends agree with the tokens beside them.

Leaves are short (``leaf`` characters), so that nine of ten documents are joined from several; the library encodes a leaf.
The value of a piece is always the encoding of that piece alone, so the join is associative and any tree gives the same ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import batch_map, query, table

_OTHER = r"[^\p{White_Space}\p{L}\p{N}]"
_AFTER_INK = rf"(?<=\p{{L}})(?=\P{{L}})|(?<=\p{{N}})(?=\P{{N}})|(?<={_OTHER})(?=[\p{{White_Space}}\p{{N}}])|(?<=(?!'){_OTHER})(?=\p{{L}})"
_SURE_INK = regex.compile(_AFTER_INK)
_SURE = regex.compile(_AFTER_INK + r"|(?<=(?! )\p{White_Space})(?=\P{White_Space})")
_ONE_CLASS = regex.compile(rf"\p{{L}}+|\p{{N}}+|\p{{White_Space}}+|{_OTHER}+")
#: Above this many characters without a sure cut on both sides, a cut inside one long match is tried.
_LONG = 256


class TreeEncoder:
    """Encoder and decoder for a file of base64 tokens and ranks, and a pattern of matches to merge apart."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = 512):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.leaf = max(1, leaf)
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.bytes_of}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.base.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, left_text: str, right_text: str, left: list[int], right: list[int]) -> list[int]:
        """Ids of ``left_text + right_text`` from the ids of both."""
        return self._join(left_text + right_text, 0, len(left_text), len(left_text) + len(right_text), left, right)

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        if lo == mid or mid == hi:
            return left + right
        width = 16
        while True:
            a, b = max(lo, mid - width), min(hi, mid + width)
            part = text[a:b]
            cuts = [a + m.start() for m in _SURE.finditer(part)]
            i = max((x for x in cuts if x < mid), default=lo if a == lo else None)
            j = next((a + m.start() for m in _SURE_INK.finditer(part) if a + m.start() >= mid), hi if b == hi else None)
            if i is not None and j is not None:
                head, _ = self._cut(left[::-1], len(text[i:mid].encode()))
                tail, _ = self._cut(right, len(text[mid:j].encode()))
                return left[: len(left) - head] + self.base.encode_ordinary(text[i:j]) + right[tail:]
            if width > _LONG and _ONE_CLASS.fullmatch(part) and a > lo and b < hi:
                met = self._join_inside(left, right, len(text[a:mid].encode()), len(text[mid:b].encode()))
                if met is not None:
                    return met
            width *= 2

    def _cut(self, ids: Sequence[int], size: int) -> tuple[int, int]:
        """How many leading ids make up ``size`` bytes."""
        n = got = 0
        while got < size:
            got += len(self.bytes_of[ids[n]])
            n += 1
        if got != size:
            raise AssertionError("a sure cut lies inside a token")
        return n, got

    def _join_inside(self, left: list[int], right: list[int], left_bytes: int, right_bytes: int) -> list[int] | None:
        """Join inside one match, of which so many bytes at least lie on either side; None if they do not suffice."""
        k = 4
        while True:
            if k >= len(left) or k >= len(right):
                return None
            if sum(len(self.bytes_of[t]) for t in left[-k - 1 :]) > left_bytes or sum(len(self.bytes_of[t]) for t in right[: k + 1]) > right_bytes:
                return None
            window = self.merge(b"".join(self.bytes_of[t] for t in [*left[-k:], *right[:k]]))
            if self._stays(left[-k - 1], window[0]) and self._stays(window[-1], right[k]):
                return left[:-k] + window + right[k:]
            k *= 2

    def _stays(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def merge(self, data: bytes) -> list[int]:
        """Merge the bytes of one match: the pair of lowest rank first, the leftmost among equal ones."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def decode(self, ids: Sequence[int]) -> bytes:
        if len(ids) <= 2 * self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def encoder(path: str, leaf: int = 512) -> TreeEncoder:
    return TreeEncoder(path, leaf=leaf)


def encode_table(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 512) -> DataFrame:
    """id, n_tokens, ids of every text. NULL counts as empty; an empty text has no ids. Rows are kept one to one."""

    def block(rows: dict[str, list]) -> dict[str, list]:
        ids = [encoder(ranks_path, leaf).encode(t or "") for t in rows["text"]]
        return {id_col: rows["id"], "n_tokens": list(map(len, ids)), "ids": ids}

    return batch_map(docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"`{text_col}` AS text"), block, f"`{id_col}` long, n_tokens long, ids array<int>", 64)


def decode_table(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text of every list of ids; NULL counts as no ids."""

    def block(rows: dict[str, list]) -> dict[str, list]:
        return {id_col: rows["id"], "text": [encoder(ranks_path).decode(x or []).decode("utf-8", "replace") for x in rows["ids"]]}

    return batch_map(encoded.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"`{ids_col}` AS ids"), block, f"`{id_col}` long, text string", 64)


def round_trip_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 512) -> DataFrame:
    """id, n_tokens, SHA-256 of the decimal ids and of the bytes they decode to; the ids stay in the task."""

    def block(rows: dict[str, list]) -> dict[str, list]:
        own = encoder(ranks_path, leaf)
        out: dict[str, list] = {"id": rows["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in rows["text"]:
            ids = own.encode(text or "")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(own.decode(ids)).hexdigest())
        return out

    return batch_map(docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"`{text_col}` AS text"), block, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 64).withColumnRenamed("id", id_col)


@query("op5_bpe")
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
