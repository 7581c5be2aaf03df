"""Token counts of a byte-level BPE vocabulary: rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch of texts are found with array operations over their code points, equal ones are folded, and
the distinct ones lie end to end in one array of symbols. In every round each pre-token applies its pair of lowest rank,
all pre-tokens at once; one without a pair that merges leaves the array, and its remaining symbols are its tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.text import Texts, Words, filled, slices

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of text whose distinct pre-tokens are merged together.
TOGETHER = 4 << 20
LETTER, NUMBER, SPACE, OTHER = range(4)
# The code points of Unicode's property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NEVER = np.int32(np.iinfo(np.int32).max)


@cache
def kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    first = "".join(unicodedata.category(chr(i))[0] for i in range(0x110000))
    codes = np.frombuffer(first.encode(), np.uint8)
    out = np.full(len(codes), OTHER, np.uint8)
    out[codes == ord("L")] = LETTER
    out[codes == ord("N")] = NUMBER
    out[WHITE] = SPACE
    return out


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """The merges of a vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids = file["model"]["vocab"]
        rules = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.special = [t["content"].encode() for t in file["added_tokens"]]
        # Bytes that print stand for themselves, the others for the code points from 256 on, in order.
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.byte = np.array([ids[chr(b if b in prints else next(rest))] for b in range(256)], np.int32)
        left, right, made = (np.array([ids[x] for x in column], np.int64) for column in ([a for a, _ in rules], [b for _, b in rules], [a + b for a, b in rules]))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.made = made.astype(np.int32)
        # A rule is settled if no pair with its product merges earlier: then all its places in a pre-token may merge at once.
        earliest = np.full(max(ids.values()) + 1, NEVER)
        ranks = np.arange(len(rules), dtype=np.int32)
        np.minimum.at(earliest, left, ranks)
        np.minimum.at(earliest, right, ranks)
        self.settled = earliest[made] > ranks

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NEVER if it doesn't merge."""
        if not len(left) or not len(self.keys):
            return np.full(len(left), NEVER)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NEVER)


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def pretokens(texts: Texts, special: list[bytes]) -> tuple[Words, np.ndarray]:
    """The pre-tokens, and for each text how often it holds a special string (each one token, no part of a pre-token).

    A pre-token is a contraction, or letters, numbers or other marks with one space before them, or white space; the
    last white space before something else is left to it if it is a plain space, and stands alone if not.
    """
    raw = texts.bytes
    found = [(m.start(), m.end()) for s in special for m in re.finditer(re.escape(s), raw)] if any(s[0] in raw for s in special) else []
    spots = np.array(sorted(found), np.int64).reshape(-1, 2)
    owner = np.searchsorted(texts.offsets, spots, side="right")
    spots = spots[np.searchsorted(texts.offsets, spots[:, 0], side="right") == np.searchsorted(texts.offsets, spots[:, 1] - 1, side="right")] if len(spots) else spots
    owner = np.searchsorted(texts.offsets, spots[:, 0], side="right") - 1
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    code = _code_points(raw, lead)
    kind = kinds()[code]
    n = len(code)
    cut = np.zeros(n + 1, bool)
    cut[np.searchsorted(lead, np.concatenate([texts.offsets, spots.ravel()]))] = True
    cut[n] = True
    if not n:
        return Words(texts, np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(texts.n, np.int64)
    begins = cut[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(begins)
    after = np.append(first[1:], n)
    # White space before something else.
    white = (kind[first] == SPACE) & ~cut[after]
    last, then = after[white] - 1, after[white]
    begins[last] = True
    begins[then[code[last] == 32]] = False
    # Contractions.
    mark = first[(code[first] == 39) & (after - first == 1) & ~cut[after]]
    mark = mark[begins[mark] & (kind[mark + 1] == LETTER)]
    if len(mark):
        one = code[mark + 1]
        within = mark + 2 < n
        second = np.where(within, code[np.minimum(mark + 2, n - 1)], 0)
        second[within] *= ~cut[mark[within] + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (second == ord("e")) | (one == ord("l")) & (second == ord("l"))
        begins[mark[short | long] + 1] = False
        end = np.concatenate([mark[short] + 2, mark[long] + 3])
        begins[end[end < n]] = True
    at = lead[begins]
    starts, ends = at, np.append(at[1:], len(raw))
    if len(spots):
        inside = np.searchsorted(spots[:, 0], starts, side="right") - 1
        free = (inside < 0) | (starts >= spots[np.maximum(inside, 0), 1])
        starts, ends = starts[free], ends[free]
    return Words(texts, starts, ends), np.bincount(owner, minlength=texts.n)


def _code_points(raw: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points whose UTF-8 begins at ``lead``."""
    byte = raw[lead].astype(np.int32)
    out = byte.copy()
    for length, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        some = np.flatnonzero(byte >= (0xC0, 0xE0, 0xF0)[length - 2])
        if not len(some):
            break
        value = byte[some] & mask
        for k in range(1, length):
            value = value << 6 | (raw[np.minimum(lead[some] + k, len(raw) - 1)] & 0x3F)
        out[some] = value
    return out


def merged(symbols: np.ndarray, sizes: np.ndarray, rules: Merges) -> np.ndarray:
    """How many symbols each sequence keeps; sequence k has the next ``sizes[k]`` of ``symbols``."""
    count = sizes.copy()
    of = np.flatnonzero(sizes > 1)
    keep = np.repeat(sizes > 1, sizes)
    symbols, sizes = symbols[keep], sizes[of]
    rank = np.append(rules.ranks(symbols[:-1], symbols[1:]), NEVER) if len(symbols) else np.zeros(0, np.int32)
    rank[np.cumsum(sizes) - 1] = NEVER  # a sequence's last symbol has no pair
    while len(of):
        start = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(rank, start)
        going = least < NEVER
        if not going.all():
            count[of[~going]] = sizes[~going]
            keep = np.repeat(going, sizes)
            symbols, rank, of, sizes, least = symbols[keep], rank[keep], of[going], sizes[going], least[going]
            if not len(of):
                break
            start = np.cumsum(sizes) - sizes
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        owner = np.searchsorted(start, at, side="right") - 1
        # Of places that overlap every second one merges, from the left; of a rule that isn't settled only the first.
        run = np.ones(len(at), bool)
        run[1:] = at[1:] != at[:-1] + 1
        place = np.arange(len(at))
        nth = place - np.maximum.accumulate(np.where(run, place, 0))
        new = np.ones(len(at), bool)
        new[1:] = owner[1:] != owner[:-1]
        use = (nth % 2 == 0) & (new | rules.settled[least[owner]])
        at, owner = at[use], owner[use]
        symbols[at] = rules.made[rank[at]]
        rank[at] = rank[at + 1]  # whether a pair follows at all
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))
        ends = np.zeros(len(symbols), bool)
        ends[start + sizes - 1] = True
        ends[at] |= ends[at + 1]
        symbols, rank, ends = symbols[keep], rank[keep], ends[keep]
        sizes = sizes - np.bincount(owner, minlength=len(of))
        changed = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
        changed = changed[~ends[changed]]
        rank[moved] = NEVER
        rank[changed] = rules.ranks(symbols[changed], symbols[changed + 1])
    return count


def tokens(texts: Texts, rules: Merges) -> np.ndarray:
    """The number of tokens of each text."""
    words, special = pretokens(texts, rules.special)
    _, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    sizes = (words.ends - words.starts)[at]
    total = int(sizes.sum())
    place = np.repeat(words.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
    each = merged(rules.byte[texts.bytes[place]], sizes, rules)[which]
    sums = np.concatenate([[0], np.cumsum(each)])
    return sums[words.first[1:]] - sums[words.first[:-1]] + special


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row's (id_col, n_bytes, n_tokens, over_limit), for a byte-level BPE file of the installed vocabularies.

    Null and empty texts have no bytes and no tokens. Repeated rows come out as often as they came in; a null id stays
    null; empty tables give empty results and other columns don't matter. Texts of any length are counted whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = merges(vocabulary_path(vocabulary))
        for batch in batches:
            column = filled(batch.column(1))
            for low, high in slices(column, TOGETHER):
                texts = Texts(column.slice(low, high - low))
                n = tokens(texts, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(texts.offsets)), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(count, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
