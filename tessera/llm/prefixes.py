"""Token counts of every prefix of a text, by dynamic programming over prefixes.

The byte-level BPE encoding of a pre-token's prefix is that of a shorter prefix and one more token, and which token that is
follows from a test of two neighbours: a sequence of tokens is an encoding if and only if each pair of neighbours in it is
the encoding of their joint bytes. So one pass over a pre-token finds, for each prefix, its last token and its count. Prefixes
of a text add what stands before the pre-token that they end in. Once stored, the counts answer how many tokens a text has,
how many any truncation of it has, and where to cut it for a budget, without encoding anything again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import added_tokens

#: The query's limit.
LIMIT_TOKENS = 512
#: Counts of pre-tokens that a worker remembers, and the longest of them; others are found anew each time.
REMEMBERED, REMEMBERED_CHARS = 600_000, 64
#: Up to here all libraries know the same letters and numbers; texts beyond are cut by the tokenizer's own pre-tokenizer.
_SETTLED = "Ԁ"


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def _spelled_out(pattern: str) -> str:
    """A pattern for characters below ``_SETTLED`` with its classes of letters, numbers and white space as lists of ranges."""
    import regex

    below = "".join(map(chr, range(ord(_SETTLED))))
    for name, other in ((r"\p{L}", None), (r"\p{N}", None), (r"\s", r"\S")):
        ranges = "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(name + "+", below))
        # inside a class of characters the ranges are a part of it
        pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(name, ranges), pattern).replace(name, f"[{ranges}]")
        pattern = pattern.replace(other, f"[^{ranges}]") if other else pattern
    return pattern


class PrefixCounter:
    """Counts of all prefixes of texts by a byte-level BPE tokenizer's JSON."""

    def __init__(self, tokenizer_json: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(tokenizer_json, encoding="utf-8") as f:
            told = json.load(f)
        if told["normalizer"] or told["model"]["type"] != "BPE" or told["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"not a plain byte-level BPE: {tokenizer_json}")
        tokenizer = Tokenizer.from_file(tokenizer_json)
        self._model, self._own_cut = tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str
        self._cut, self._letters = regex.compile(pattern), _alphabet()
        self._fast_cut = re.compile(_spelled_out(pattern)).findall
        added = sorted((token for token, _ in added_tokens(tokenizer_json)), key=len, reverse=True)
        self._added = regex.compile("|".join(map(regex.escape, added))) if added else None
        #: White space of several characters that doesn't end a text.
        self._spaces = regex.compile(r"\s\s+(?=\S)")
        self._contraction = regex.compile(r"'\p{L}{2}")
        #: Tokens by number, from one on; zero stands for none.
        self._tokens: list[str] = ["", *told["model"]["vocab"]]
        self._number = {token: k for k, token in enumerate(self._tokens)}
        self._longest = max(map(len, self._tokens))
        self._of_id = {i: self._number[token] for token, i in told["model"]["vocab"].items()}
        self._after: dict[int, tuple[list[int], list[int]]] = {}
        self._inside: dict[int, list[tuple[int, int]]] = {}
        self._pairs: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _fits(self, left: int, right: int) -> bool:
        """Whether the joint text of two tokens (0: none to the left) is encoded as just these."""
        known = self._pairs.get(left << 32 | right)
        if known is not None:
            return known
        pair = [self._tokens[t] for t in (left, right) if t]
        found = [t.value for t in self._model.tokenize("".join(pair))] == pair
        if len(self._pairs) >= REMEMBERED:
            self._pairs.clear()
        self._pairs[left << 32 | right] = found
        return found

    def _numbers(self, s: str) -> list[int]:
        """The tokens of one pre-token, by its characters in the vocabulary's alphabet."""
        return [self._of_id[t.id] for t in self._model.tokenize(s)]

    def _parts(self, token: int) -> list[tuple[int, int]]:
        """Of each prefix of a token that is shorter than it: its last token and that one's length."""
        s = self._tokens[token]
        found = [self._numbers(s[:k])[-1] for k in range(1, len(s))]
        self._inside[token] = out = [(t, len(self._tokens[t])) for t in found]
        return out

    def _other(self, s: str, j: int, last: list[int]) -> int:
        """The last token of the first ``j`` characters: the only one that fits the last token before it."""
        for i in range(max(0, j - self._longest), j):
            token = self._number.get(s[i:j])
            if token and self._fits(last[i], token):
                return token
        raise AssertionError(f"no encoding of {s[:j]!r}")

    def _step(self, s: str, token: int, j: int, last: list[int], count: list[int]) -> bool:
        """Adds the prefixes that end in or with a token at ``j``; whether they follow from it and the token before it alone."""
        alone = True
        # a prefix that ends in a token ends as that part of it does, if that fits what stands before
        for end, size in self._inside.get(token) or self._parts(token):
            j += 1
            if not self._fits(last[j - size], end):
                alone = False
                end = self._other(s, j, last)
                size = len(self._tokens[end])
            last.append(end)
            count.append(count[j - size] + 1)
        last.append(token)
        count.append(count[j + 1 - len(self._tokens[token])] + 1)
        return alone

    def _dynamic(self, piece: str) -> list[int]:
        """For each prefix of one pre-token, by its characters, the number of its tokens."""
        s = piece.encode().decode("latin-1").translate(self._letters)
        last, count, before, known = [0], [0], 0, self._after
        for token in self._numbers(s):
            j = len(count) - 1
            step = known.get(before << 32 | token)
            if step is not None:
                last += step[0]
                done = count[j]
                count += [done + n for n in step[1]]
            elif self._step(s, token, j, last, count):
                if len(known) >= REMEMBERED:
                    known.clear()
                known[before << 32 | token] = last[j + 1 :], [n - count[j] for n in count[j + 1 :]]
            before = token
        if len(piece) == len(s):
            return count[1:]
        place, out = 0, []
        for ch in piece:
            place += len(ch.encode())
            out.append(count[place])
        return out

    def _piece(self, piece: str) -> list[int]:
        out = self._dynamic(piece)
        if piece[0] == "'" and self._contraction.fullmatch(piece):
            # a contraction's prefix isn't one, and falls into two pre-tokens
            out[1] = self._dynamic(piece[0])[-1] + self._dynamic(piece[1])[-1]
        return out

    def _remember(self, piece: str) -> bytes | None:
        """The counts of a pre-token's prefixes, a byte each, kept for the next time; None where it is too long for that.

        When so many are kept they are set aside, and taken up again one by one as they recur; what doesn't is forgotten next time.
        """
        counts = self._older.get(piece)
        if counts is None:
            if len(piece) > REMEMBERED_CHARS or max(found := self._piece(piece)) > 255:
                return None
            counts = bytes(found)
        if len(self._known) >= REMEMBERED:
            self._older, self._known = self._known, {}
        self._known[piece] = counts
        return counts

    def _plain(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text without added tokens, from the empty one on."""
        out = np.zeros(len(text) + 1, dtype=np.int32)
        if not text:
            return out
        if max(text) < _SETTLED:
            pieces = self._fast_cut(text)
        else:
            pieces = [text[a:b] for _, (a, b) in self._own_cut(text)]
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lengths)
        parts, long = list(map(self._known.get, pieces)), []
        if None in parts:
            for k, part in enumerate(parts):
                if part is None:
                    parts[k] = self._remember(pieces[k])
                    if parts[k] is None:
                        parts[k] = bytes(len(pieces[k]))
                        long.append((k, self._piece(pieces[k])))
        out[1:] = np.frombuffer(b"".join(parts), dtype=np.uint8)
        for k, found in long:
            out[ends[k] - lengths[k] + 1 : ends[k] + 1] = found
        own = out[ends]
        out[1:] += np.repeat(np.cumsum(own) - own, lengths).astype(np.int32)
        # white space is one pre-token up to its last character, but at a prefix's end up to its end
        for m in self._spaces.finditer(text):
            out[m.end()] = out[m.start()] + (self._known.get(m[0]) or self._remember(m[0]) or self._piece(m[0]))[-1]
        return out

    def counts(self, text: str) -> np.ndarray:
        """The number of tokens of each prefix of a text, the empty one first, as if each were encoded by itself."""
        if self._added is None or not (marks := [m.span() for m in self._added.finditer(text)]):
            return self._plain(text)
        parts, base, at = [np.zeros(1, dtype=np.int32)], 0, 0
        for begin, end in marks:
            # a prefix that ends inside an added token's string holds a part of it, which is plain text
            part = self._plain(text[at : end - 1])
            whole = base + int(part[begin - at]) + 1
            parts += [base + part[1:], np.array([whole], dtype=np.int32)]
            base, at = whole, end
        return np.concatenate([*parts, base + self._plain(text[at:])[1:]])


@lru_cache(maxsize=2)
def counter(tokenizer_json: str, pattern: str) -> PrefixCounter:
    """The counter of a tokenizer, once per worker."""
    return PrefixCounter(tokenizer_json, pattern)


def prefix_counts(docs: DataFrame, tokenizer_json: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, and ``counts``, the number of tokens of each prefix, the empty one first.

    Prefixes end after whole characters, and each counts as a text of its own; strings of added tokens are those tokens, as the
    tokenizer's library has them. A null text counts as empty: no bytes, counts [0]. Rows that repeat give rows that repeat; an
    empty table gives none; other columns are not looked at. A text of any length is one row with four bytes a character.
    """
    rows = common.bound_batches(docs).select(common.text_id(docs), F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(tokenizer_json, pattern)
        for batch in batches:
            # a few rows at a time, as counts are larger than texts
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(t.encode()) for t in part["text"]], "counts": [own.counts(t) for t in part["text"]]})

    return common.typed_id(rows.mapInPandas(count, "doc_id string, n_bytes long, counts array<int>"), docs)


def tokens_of(counts: Column, chars: Column | int | None = None) -> Column:
    """How many tokens the first ``chars`` characters have; all if none are told or there aren't so many; null if negative."""
    if chars is None:
        return F.get(counts, F.size(counts) - 1).cast("long")
    return F.get(counts, F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts) - 1)).cast("long")


def chars_within(counts: Column, budget: Column | int) -> Column:
    """How many characters the longest prefix of at most ``budget`` tokens has; null for a negative budget.

    Counts may fall as a prefix grows, so prefixes that have more tokens may be shorter than it.
    """
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i))).cast("long")


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and whether they pass the limit, with the longest prefix within it; edge cases as ``prefix_counts`` states."""
    import public_tokenizers

    found = prefix_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    n = tokens_of(F.col("counts"))
    return found.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > LIMIT_TOKENS).alias("over_limit"), chars_within(F.col("counts"), LIMIT_TOKENS).alias("chars_within_limit"))
