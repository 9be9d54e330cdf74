"""Operator 10: byte-level BPE by prefix dynamic programming.

For each prefix of a byte string the encoding of that prefix ends in exactly one token: the token t whose own prefix
ends in a token that may stand before t. ``Coder.extend`` stores that last token for every prefix, from left to right;
the encoding is read backwards from the end. Appending bytes therefore only adds entries, and after an edit entries
are computed anew from the edit until a whole token length of them agrees with the old ones (``Coder.edit``).

Two tokens may stand side by side if joining their histories of merges by rank never prefers a merge across the
border; ``Coder.fits`` walks both histories from the latest merge back.

The splitting pattern is applied by the ``regex`` module. Where a match holds a character that Python's character data do not
know, its class may differ between that module and the tiktoken library, so the text is left to the library.

Nulls: a null text is encoded as an empty one (no ids, the hashes of empty strings); repeated rows give repeated
rows, an empty table an empty result. Long texts are encoded whole; a worker's cache of pre-tokens is bounded.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kgloom.llm.common import Memo, documents, id_and_text, kept, map_rows


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Coder:
    """Encoder and decoder of single pre-tokens for a table of merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {i: token for token, i in ranks.items()}
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                ends.setdefault(token[-3:], {1, 2}).add(len(token))
        self.sizes = {end: tuple(sorted(sizes, reverse=True)) for end, sizes in ends.items()}  # lengths of the tokens with this end
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}  # what fits() said, a bounded cache
        self.most_pairs = 300_000
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[i] = (i, i)
                continue
            # The merge that makes a token joins the two tokens that its bytes have when only lower ranks exist.
            halves = [(a, b) for cut in range(1, len(token)) if (a := ranks.get(token[:cut], i)) < i and (b := ranks.get(token[cut:], i)) < i and self.fits(a, b)]
            self.parts[i] = halves[0] if halves else (i, i)
            if halves:
                self.joined[halves[0]] = i

    def fits(self, left: int, right: int) -> bool:
        """True if the two tokens can be neighbours in an encoding."""
        bound = 1 << 60
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            if left > right:  # undo the later merge; the bytes at the border decide
                bound, left = left, self.parts[left][1]
                if left == bound:
                    bound, right = right + 1, self.parts[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound, right = right + 1, self.parts[right][0]
                if right + 1 == bound:
                    bound, left = left, self.parts[left][1]
                    if left == bound:
                        return True

    def extend(self, data: bytes, last: list[int] | None = None, stop: int | None = None) -> list[int]:
        """Last tokens of all prefixes (entry 0 is unused), continuing from those of a shorter prefix, up to ``stop`` bytes."""
        last = last or [-1]
        ranks, pairs, lengths = self.ranks.get, self.pairs, self.sizes.get
        for end in range(len(last), (len(data) if stop is None else stop) + 1):
            for size in lengths(data[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                if size < end:
                    token = ranks(data[end - size : end])
                    if token is None:
                        continue
                    pair = last[end - size] << 24 | token
                    fit = pairs.get(pair)
                    if fit is None:
                        if len(pairs) >= self.most_pairs:
                            pairs.clear()
                        fit = pairs[pair] = self.fits(last[end - size], token)
                    if fit:
                        break
                elif size == end and (token := ranks(data[:end])) is not None:
                    break
            else:
                raise ValueError("the ranks do not cover every byte")
            last.append(token)
        return last

    def edit(self, data: bytes, last: list[int], start: int, stop: int, put: bytes) -> tuple[bytes, list[int], int]:
        """Replace data[start:stop] by put: the new bytes, their last tokens and how many entries were computed."""
        new, moved = data[:start] + put + data[stop:], len(put) - (stop - start)
        out, same, done = last[: start + 1], 0, 0
        for end in range(start + 1, len(new) + 1):
            if same >= self.longest and end > start + len(put) + self.longest:
                return new, out + last[end - moved :], done
            self.extend(new, out, end)
            done += 1
            same = same + 1 if end > start + len(put) and out[end] == last[end - moved] else 0
        return new, out, done

    def read(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding, read backwards."""
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return ids[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read(data, self.extend(data))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Unsure(Exception):
    """A match holds a character whose class the libraries may see differently."""


class TextCoder:
    """Splits texts by a pattern and encodes each match on its own; matches are cached."""

    def __init__(self, ranks_file: str, pattern: str, most: int = 200_000):
        import regex

        self.coder, self.pattern, self.library = Coder(read_ranks(ranks_file)), pattern, None
        self.find = regex.compile(pattern).findall
        self.cache = Memo(self._match, most)
        self.shown = {i: str(i) for i in self.coder.bytes_of}

    def _match(self, match: str) -> list[int]:
        if not match.isascii() and any(map("Cn".__eq__, map(unicodedata.category, match))):
            raise Unsure
        return self.coder.encode(match.encode())

    def encode(self, text: str) -> list[int]:
        try:
            return list(chain.from_iterable(map(self.cache.__getitem__, self.find(text))))
        except Unsure:
            if self.library is None:
                import tiktoken

                self.library = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.coder.ranks, special_tokens={})
            return self.library.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.coder.decode(ids)


def text_coder(ranks_file: str, pattern: str) -> TextCoder:
    """One for all tasks of a worker, with its cache."""
    return kept(("bpe", ranks_file, pattern), lambda: TextCoder(ranks_file, pattern))


def coders(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, the ids and the decoded text of every document."""

    def make():
        coder = text_coder(ranks_file, pattern)
        shown = coder.shown

        def each(columns: list[list]) -> list:
            doc_ids, texts = columns
            ids = [coder.encode(t) for t in texts]
            back = [coder.decode(x) for x in ids]
            out = [doc_ids, [len(x) for x in ids], [hashlib.sha256(",".join(map(shown.__getitem__, x)).encode()).hexdigest() for x in ids], [hashlib.sha256(b).hexdigest() for b in back]]
            return [*out, *([ids] if with_ids else []), *([[b.decode() for b in back]] if with_text else [])]

        return each

    fields, schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields, schema = [*fields, ("ids", pa.list_(pa.int32()))], schema + ", ids array<int>"
    if with_text:
        fields, schema = [*fields, ("decoded", pa.string())], schema + ", decoded string"
    return map_rows(id_and_text(docs, id_col, text_col), schema, pa.schema(fields), make)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return coders(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids, with the hash of what they decode to."""
    import public_tokenizers

    return coders(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


QUERIES = {"op10_bpe": op10_bpe}
SQL: dict[str, str] = {}
