"""Token counts by merging, without ids (operator 5).

The vocabulary is byte-pair encoding with word ends: a text is composed (NFC), put in lower case, split into
words, single digits and runs of other signs; white space is dropped. A word starts as its bytes, the last
one marked as the end. Neighbours sit in a linked list, possible merges in a heap by rank and place: the
lowest is popped again and again, merged if both parts still stand, and the new neighbours are pushed. The
count is the number of bytes less the merges; identifiers are never looked up. Counts of short pieces
between white space are remembered per worker.

Texts with characters beyond U+024F, or control signs that Python alone takes for blanks, are composed and
split by the library's own normalizer and pre-tokenizer. Special strings inside a text count one each.
Odd input: null and empty texts have no tokens; repeated rows are repeated; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.llm.bpe import byte_symbols
from lifecurve.llm.common import map_slices, slices, texts

LIMIT_TOKENS = 2048
CACHE_UNITS = CACHE_WORDS = 400_000
UNIT_CHARS = WORD_CHARS = 48
#: Fixed value: the words of the vocabulary.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bits of a symbol's number, and of a place in a text.
SYMBOL, PLACE = 20, 40


def merged_count(symbols: list[int], ranks: dict[int, int]) -> int:
    """Symbols left when no neighbours can be merged.

    ``ranks``: a pair (first << SYMBOL | second) to its merge (rank << SYMBOL | new symbol).
    """
    n, rank_of = len(symbols), ranks.get
    heap, last = [], symbols[0]
    for i in range(1, n):
        now = symbols[i]
        merge = rank_of(last << SYMBOL | now)
        if merge is not None:
            heap.append(merge << PLACE | i - 1)
        last = now
    if not heap:
        return n
    heapify(heap)
    after, before, left = [*range(1, n), -1], [*range(-1, n - 1)], n
    while heap:
        top = heappop(heap)
        merge, i = top >> PLACE, top & (1 << PLACE) - 1
        j = after[i]
        if symbols[i] < 0 or j < 0 or rank_of(symbols[i] << SYMBOL | symbols[j]) != merge:
            continue  # a part has gone or grown since
        new = symbols[i] = merge & (1 << SYMBOL) - 1
        symbols[j] = -1
        left -= 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            merge = rank_of(new << SYMBOL | symbols[k])
            if merge is not None:
                heappush(heap, merge << PLACE | i)
        k = before[i]
        if k >= 0:
            merge = rank_of(symbols[k] << SYMBOL | new)
            if merge is not None:
                heappush(heap, merge << PLACE | k)
    return left


class Words(dict):
    """Tokens of each word, by merging when first seen."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, number = model.get("end_of_word_suffix") or "", {}
        known = lambda s: number.setdefault(s, len(number))
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(known(a) << SYMBOL | known(b), rank << SYMBOL | known(a + b))
        self.inner = [known(s) for s in byte_symbols()]
        self.final = [known(s + end) for s in byte_symbols()]

    def merged(self, word: bytes) -> int:
        symbols = [*map(self.inner.__getitem__, word)]
        symbols[-1] = self.final[word[-1]]
        return merged_count(symbols, self.ranks)

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode())
        if len(word) <= WORD_CHARS:
            self[word] = n
        return n


class Counter(dict):
    """Tokens of each piece between white space, counted when first seen."""

    ODD = re.compile("[^\x00-\x1b\x20-ɏ]")

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        specials = [t.content for t in library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.words = Words(path)
        self.back = {s: b for b, s in enumerate(byte_symbols())}
        self.split = regex.compile(WORD).findall

    def __missing__(self, unit: str) -> int:
        n = sum(map(self.words.__getitem__, self.split(unit)))
        if len(unit) <= UNIT_CHARS:
            self[unit] = n
        return n

    def section(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not self.ODD.search(text):
            return sum(map(self.__getitem__, text.lower().split()))
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return sum(self.words.merged(bytes(map(self.back.__getitem__, piece))) for piece, _ in pieces)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if len(self) > CACHE_UNITS:
            self.clear()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if self.special is None or not self.special.search(text):
            return self.section(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.section, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each worker process and vocabulary."""
    return Counter(path)


def token_counts(
    docs: DataFrame, path: str | None = None, *, limit: int = LIMIT_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, in one pass without a shuffle."""
    path = path or default_path()

    def run(batches):
        c = counter(path)
        for part in slices(batches):
            all_texts = texts(part, "text")
            n = [c.count(t) for t in all_texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t.encode()) for t in all_texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
