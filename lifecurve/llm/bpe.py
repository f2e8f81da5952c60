"""Byte-level BPE encoding and decoding; long texts by tree concatenation (operator 3).

Encoding. The ids are those of the tokenizers library for the given vocabulary file. Where the file is a
plain byte-level vocabulary whose ids follow the merges, Latin-1 texts go through tiktoken with the same
vocabulary as ranks, which gives the same ids three times as fast; all other texts, with characters whose
class may differ between Unicode tables, go through the library itself. The tests compare both.

Tree concatenation. A text of more than ``piece_chars`` code points is cut into halves, quarters and so on
at any character; the pieces are encoded by different tasks, then joined pairwise. Around each join a
window of tokens is encoded again and grows until both sides agree: it ends at a blank before a non-blank,
which starts a pre-token whatever stands around it, or inside a run of letters (or digits) where its
outermost token is the one that the side has there. That is exact:
neighbouring tokens of a right encoding are right in any longer text, and two encodings that share a token
can be put together at it. A window that never agrees ends up as both pieces whole.

Results for odd input: null and empty texts have no ids; rows repeated in the input are repeated in the
output; null ids are carried along; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.llm.common import add_row, map_slices, slices, texts

PIECE_CHARS = 8192
#: Fixed value: the pre-tokens of a byte-level vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The printable stand-ins of bytes in a byte-level vocabulary: visible Latin-1 stands for itself.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The symbol of each byte value."""
    rest = iter(range(256, 512))
    return [chr(b) if b in set(VISIBLE) else chr(next(rest)) for b in range(256)]


class Codec:
    """The library's ids of a text, their bytes, and the join of two encodings."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        names = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        value = {s: b for b, s in enumerate(byte_symbols())}
        self.table = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            plain = i not in self.specials.values() and all(c in value for c in token)
            self.table[i] = bytes(value[c] for c in token) if plain else token.encode()
        self.ranks = self._ranks(path)

    def _ranks(self, path: str):
        """The vocabulary as ranks, if ids follow the order of merges and nothing else acts on a text."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        merged = [model["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain or any(odd) or any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            return None
        ranks = {self.table[i]: i for i in model["vocab"].values() if i not in self.specials.values()}
        return tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def sections(self, text: str) -> list[str]:
        """The text between special strings, the strings themselves at odd places."""
        if self.special is None or not any(s in text for s in self.specials):
            return [text]
        return self.special.split(text)

    def section(self, text: str) -> bytes:
        """Ids of a text without special strings."""
        if not text:
            return b""
        if self.ranks is not None:
            try:
                text.encode("latin-1")
                return np.array(self.ranks.encode_ordinary(text), self.kind).tobytes()
            except UnicodeEncodeError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        parts = self.sections(text)
        if len(parts) == 1:
            return np.frombuffer(self.section(text), self.kind)
        ids = [np.array([self.specials[p]], self.kind).tobytes() if k % 2 else self.section(p) for k, p in enumerate(parts)]
        return np.frombuffer(b"".join(ids), self.kind)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")

    # The joins.

    def _edge(self, ids: np.ndarray, at: int) -> str:
        """What stands at the boundary before token ``at``: 'unit', 'run' or '' (no place for a cut)."""
        before, after = self.bytes_of(ids[max(0, at - 8) : at]), self.bytes_of(ids[at : at + 8])
        if after[0] & 0xC0 == 0x80:
            return ""
        if after[0] == 0x20 and len(after) > 1 and (33 <= after[1] < 127 or 0xC3 <= after[1] <= 0xDF):
            return "unit"
        left, right = before.decode("utf-8", "ignore")[-1:], after.decode("utf-8", "ignore")[:1]
        if b"'" in before[-4:] or not left or not right:
            return ""
        return "run" if (_letter(left) and _letter(right)) or (left + right).isascii() and (left + right).isdigit() else ""

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
        """Ids of the joined texts of two encodings, and the tokens encoded again for it."""
        if not a.size or not b.size:
            return (a if a.size else b), 0
        spent = 0
        back = ahead = 8
        while True:
            i = a.size - back
            while i > 0 and (not (left := self._edge(a, i)) or len(self.bytes_of(a[i : i + 17])) < 16):
                i -= 1
            j = ahead
            while j < b.size and (not (right := self._edge(b, j)) or len(self.bytes_of(b[max(0, j - 17) : j])) < 16):
                j += 1
            i, j = max(0, i), min(j, b.size)
            window = (self.bytes_of(a[i:]) + self.bytes_of(b[:j])).decode("utf-8")
            seen = np.frombuffer(self.section(window), self.kind)
            spent += seen.size
            left_agrees = i == 0 or left == "unit" or seen[0] == a[i]
            right_agrees = j == b.size or right == "unit" or seen[-1] == b[j - 1]
            if left_agrees and right_agrees:
                return np.concatenate([a[:i], seen, b[j:]]), spent
            back = back if left_agrees else 2 * (a.size - i)
            ahead = ahead if right_agrees else 2 * j

    def tree(self, parts: list[np.ndarray]) -> tuple[np.ndarray, int]:
        """Neighbours joined, then neighbours of those, up to one encoding."""
        spent = 0
        while len(parts) > 1:
            joined = []
            for k in range(0, len(parts) - 1, 2):
                ids, n = self.join(parts[k], parts[k + 1])
                joined.append(ids)
                spent += n
            parts = joined + parts[len(parts) & ~1 :]
        return (parts[0] if parts else np.array([], self.kind)), spent


def _letter(c: str) -> bool:
    """A letter of a block that has long been complete."""
    return c.isalpha() and (c < "ɐ" or "Ͱ" <= c < "Ԁ" or "一" <= c < "龠" or "가" <= c < "힠")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(path)


def halves(text: str, piece_chars: int) -> list[str]:
    """A text cut in halves again and again until no piece is longer than ``piece_chars``."""
    count = 1
    while -(-len(text) // count) > piece_chars:
        count *= 2
    cuts = [len(text) * k // count for k in range(count + 1)]
    return [text[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def _digests(c: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    back = c.decode(ids).encode()
    return ids.size, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long, tokens_again long"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces", "tokens_again"]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=names)


def encode_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array) of every text: the plain encoding, one task per batch."""

    def run(batches):
        c = codec(path)
        for part in slices(batches):
            ids = [c.encode(t) for t in texts(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([x.size for x in ids], pa.int64()), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32()))],
                names=["doc_id", "n_tokens", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(rows, run, "doc_id long, n_tokens long, ids array<int>")


def round_trip(
    docs: DataFrame, path: str | None = None, *, piece_chars: int = PIECE_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode every text; one row per input row with counts and digests of ids and text.

    Columns: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32 bit), decoded_sha256,
    n_pieces (encoded apart), tokens_again (encoded once more around joins).
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    long_text = F.coalesce(F.length("text"), F.lit(0)) > piece_chars

    def whole(batches):
        c = codec(path)
        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            yield _out([(i, *_digests(c, c.encode(t)), 1, 0) for i, t in zip(ids, texts(part, "text"), strict=True)])

    def cut(batches):
        c = codec(path)
        for part in slices(batches):
            for row, doc, text in zip(part.column("_row").to_pylist(), part.column("doc_id").to_pylist(), texts(part, "text"), strict=True):
                found = []
                for no, section in enumerate(c.sections(text)):
                    found += [(row, doc, no, k, piece) for k, piece in enumerate(halves(section, piece_chars))]
                cols = list(zip(*found, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=["_row", "doc_id", "section", "piece", "text"])

    def encode_pieces(batches):
        c = codec(path)
        for part in slices(batches):
            ids = []
            for no, t in zip(part.column("section").to_pylist(), texts(part, "text"), strict=True):
                special = no % 2 and t in c.specials
                ids.append(np.array([c.specials[t]], c.kind).tobytes() if special else c.section(t))
            keep = [part.column(k) for k in ("_row", "doc_id", "section", "piece")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(ids, pa.binary())], names=["_row", "doc_id", "section", "piece", "ids"])

    def join_pieces(batches):
        c = codec(path)

        def finish(doc, sections):
            done = [c.tree([np.frombuffer(x, c.kind) for x in pieces]) for pieces in sections]
            ids = np.concatenate([x for x, _ in done])
            return (doc, *_digests(c, ids), sum(map(len, sections)), sum(n for _, n in done))

        now, doc, sections = None, None, []
        for part in slices(batches):
            out = []
            for row, d, no, _, ids in zip(*[part.column(k).to_pylist() for k in ("_row", "doc_id", "section", "piece", "ids")], strict=True):
                if row != now:
                    if sections:
                        out.append(finish(doc, sections))
                    now, doc, sections = row, d, []
                if no == len(sections):
                    sections.append([])
                sections[-1].append(ids)
            if out:
                yield _out(out)
        if sections:
            yield _out([finish(doc, sections)])

    short = map_slices(rows.where(~long_text), whole, OUT)
    pieces = map_slices(add_row(rows).where(long_text), cut, "_row long, doc_id long, section int, piece int, text string")
    spread = pieces.repartition("_row", "section", "piece")
    encoded = map_slices(spread, encode_pieces, "_row long, doc_id long, section int, piece int, ids binary")
    gathered = encoded.repartition("_row").sortWithinPartitions("_row", "section", "piece")
    return short.unionByName(map_slices(gathered, join_pieces, OUT))
