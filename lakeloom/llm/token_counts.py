"""Token counts at every prefix of a text.

The tokenizer never joins text over white space, so the count at a prefix that ends between two
pieces is a running sum over pieces. Inside a piece, dynamic programming over its prefixes gives
the count: a prefix's encoding is the encoding of a shorter prefix plus one token that stays as it
is beside the token before it. The table therefore answers "how many tokens have the first p
characters" and "how much of the text fits n tokens" without encoding the text again.

Null text counts as empty (no tokens). Rows that repeat give repeated rows; a null doc_id is kept;
columns beside the id and the text are not read. The work inside a piece grows with its length in
any script; only a run of characters that combine with one another is normalised again per character.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import process_store, slices, slim
from .tokens import MARKS, WordMemory, byte_letters, word_memory

END = "</w>"


class WordPrefixes:
    """Counts of all prefixes of one unit (a run of letters or of marks) by dynamic programming."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocabulary = model["vocab"]
        pairs = (tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocabulary)
        self.beside: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges, lowest rank first."""
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(symbols, symbols[1:], strict=False)]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == len(self.rank):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if not token.endswith(END):
            return list(token)
        plain = token.removesuffix(END)
        return [*plain[:-1], plain[-1] + END]

    def stays(self, before: str, token: str) -> bool:
        """Whether the two tokens, one after the other, are what their text is encoded to."""
        key = (before, token)
        if key not in self.beside:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            head = self.symbols(before) if before else []
            self.beside[key] = self.merged(head + self.symbols(token)) == [t for t in key if t]
        return self.beside[key]

    def counts(self, shown: str) -> list[int]:
        """Tokens of each prefix of `shown` (the unit in byte letters), the empty one first."""
        n = len(shown)
        cost, last, closed = [0] * (n + 1), [""] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                token = shown[start:end]
                if token in self.vocabulary and self.stays(last[start], token):
                    cost[end], last[end] = cost[start] + 1, token
                if token + END in self.vocabulary and self.stays(last[start], token + END):
                    closed[end] = cost[start] + 1
        return closed


def joining() -> frozenset[str]:
    """Characters that canonical composition may join to, or move over, the one before them."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.combining(c):
            found.add(c)
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<":
            found.update(chr(int(x, 16)) for x in parts.split()[1:])
    return frozenset(found)


class RunningCount:
    """Tokens of a text without spaces that grows by characters, in any script.

    A unit of the tokenizer's split pattern is a run of letters, one digit, a run of other marks, or an apostrophe with an
    English ending. Inside a unit the dynamic programme of `WordPrefixes` goes on from byte to byte, looking back only
    as far as what it sees is the end of some token. `mark` and `back_to` return to an earlier state.
    """

    #: Endings that are one unit with an apostrophe: a fixed part of the tokenizer's pattern.
    SHORT, LONG = frozenset("stmd"), frozenset(("re", "ve", "ll"))

    def __init__(self, library, inside: WordPrefixes):
        self.library, self.inside = library, inside
        self.letters = byte_letters()
        self.ends = {t[i:] for name in inside.vocabulary for t in [name.removesuffix(END)] for i in range(len(t))}
        self.joins = joining()
        self.kinds: dict[str, str] = {}
        self.shown_of: dict[str, str] = {}
        self.reset()

    def reset(self) -> None:
        self.shown, self.cost, self.last = [], [0], [""]
        #: Tokens before the open unit, where it starts, its kind, and what there is of an apostrophe's unit.
        self.before, self.first, self.kind, self.short = 0, 0, "", ""
        self.apostrophe: tuple = ()

    def mark(self) -> tuple:
        at = self.first
        return (len(self.shown), self.before, at, self.kind, self.short, self.apostrophe, self.cost[-1], self.last[-1])

    def back_to(self, state: tuple) -> None:
        n, self.before, self.first, self.kind, self.short, self.apostrophe, cost, last = state
        del self.shown[n:], self.cost[n + 1 :], self.last[n + 1 :]
        # A unit that was started here had set its own beginning.
        self.cost[n], self.last[n] = cost, last

    def kind_of(self, c: str) -> str:
        if c not in self.kinds:
            split = self.library.pre_tokenizer.pre_tokenize_str
            if not split(c):
                self.kinds[c] = "space"
            elif len(split(c + c)) == 2:
                self.kinds[c] = "digit"
            else:
                self.kinds[c] = "letter" if len(split("a" + c)) == 1 else "mark"
        return self.kinds[c]

    def normal(self, text: str) -> str:
        """The text as the tokenizer normalises it, but with every white space kept."""
        return "".join(map(self.lower, text if text.isascii() else unicodedata.normalize("NFC", text)))

    def lower(self, c: str) -> str:
        if c not in self.shown_of:
            self.shown_of[c] = self.library.normalizer.normalize_str(c)
        return self.shown_of[c]

    def start(self, kind: str) -> None:
        self.before, self.first, self.kind = self.count(), len(self.shown), kind
        self.cost[-1], self.last[-1] = 0, ""

    def push(self, c: str) -> None:
        """One more normalised character."""
        short, self.short = self.short, ""
        if short == "'" and c in self.SHORT:
            self.extend(c)
            self.kind = "whole"
        elif short[1:] + c in self.LONG:
            self.back_to(self.apostrophe)
            self.extend(short[1] + c)
            self.kind, self.short = "whole", ""
        else:
            if short == "'" and c in "rvl":
                self.apostrophe, self.short = self.mark(), short + c
            kind = self.kind_of(c)
            if kind != self.kind or kind == "digit":
                self.start(kind)
                if c == "'":
                    self.short = c
            if kind != "space":
                self.extend(c)

    def extend(self, text: str) -> None:
        for byte in text.encode():
            self.shown.append(self.letters[byte])
            end, token = len(self.shown), ""
            self.cost.append(0)
            self.last.append("")
            for start in range(end - 1, self.first - 1, -1):
                token = self.shown[start] + token
                if token not in self.ends:
                    break
                if token in self.inside.vocabulary and self.inside.stays(self.last[start], token):
                    self.cost[end], self.last[end] = self.cost[start] + 1, token

    def count(self) -> int:
        """Tokens of all that was pushed."""
        found, token = self.before, ""
        for start in range(len(self.shown) - 1, self.first - 1, -1):
            token = self.shown[start] + token
            if token not in self.ends:
                break
            if token + END in self.inside.vocabulary and self.inside.stays(self.last[start], token + END):
                found = self.before + self.cost[start] + 1
        return found

    def plain(self, text: str) -> list[int]:
        """Tokens of every prefix of a text that holds no special string, the empty one first."""
        self.reset()
        counts, at = [0], 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[end] in self.joins:
                end += 1
            state = self.mark()
            for stop in range(at + 1, end + 1):
                if stop > at + 1:
                    self.back_to(state)
                for c in self.normal(text[at:stop]):
                    self.push(c)
                counts.append(self.count())
            at = end
        return counts

    def every_prefix(self, text: str) -> list[int]:
        """The same for any text; a special string counts as one token once it is whole."""
        special = self.library.get_added_tokens_decoder().values()
        pattern = "|".join(re.escape(t.content) for t in special)
        counts, at = [0], 0
        for hit in re.finditer(pattern, text) if pattern else ():
            part = self.plain(text[at : hit.end() - 1])
            base = counts[-1]
            counts += [base + c for c in part[1:]]
            counts.append(base + part[hit.start() - at] + 1)
            at = hit.end()
        base = counts[-1]
        return counts + [base + c for c in self.plain(text[at:])[1:]]


class PrefixCounts:
    """The table of one text: where its pieces end, and how many tokens there are up to there."""

    def __init__(self, text: str, memory: WordMemory, inside: WordPrefixes, running: Callable[[], RunningCount]):
        self.memory, self.inside, self.running = memory, inside, running
        self.pieces = memory.pieces(text)
        n = len(self.pieces)
        self.ends = np.cumsum(np.fromiter(map(len, self.pieces), np.int64, n) + 1) - 1
        self.counts = np.cumsum(np.fromiter(map(len, map(memory.__getitem__, self.pieces)), np.int64, n)) // 4

    @property
    def total(self) -> int:
        return int(self.counts[-1])

    def of_piece(self, k: int) -> list[int]:
        """Tokens of each prefix of piece k by itself."""
        piece = self.pieces[k]
        core = piece.rstrip(MARKS)
        if not (core.isalpha() and (core.isascii() or (max(core) < "ɐ" and "İ" not in core))):
            return self.running().every_prefix(piece)
        low, marks = core.lower(), piece[len(core) :]
        by_byte = self.inside.counts(low.encode().decode("latin-1").translate(self.memory.letters))
        at = np.cumsum([0, *(len(c.encode()) for c in low)])
        head = [by_byte[i] for i in at]
        return head + [head[-1] + c for c in self.inside.counts(marks)[1:]]

    def at(self, p: int) -> int:
        """Tokens of the first `p` characters."""
        k = int(np.searchsorted(self.ends, p))
        if k == len(self.ends) or self.ends[k] == p:
            return int(self.counts[min(k, len(self.ends) - 1)])
        start, before = (int(self.ends[k - 1]) + 1, int(self.counts[k - 1])) if k else (0, 0)
        return before + self.of_piece(k)[max(p - start, 0)]

    def fit(self, limit: int) -> int:
        """The longest prefix, in characters, of at most `limit` tokens."""
        k = int(np.searchsorted(self.counts, limit, side="right"))
        if k == len(self.counts):
            return int(self.ends[-1])
        start, before = (int(self.ends[k - 1]) + 1, int(self.counts[k - 1])) if k else (0, 0)
        return start + max(i for i, c in enumerate(self.of_piece(k)) if before + c <= limit)


def token_prefixes(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    keep_table: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, and fit_chars, the longest prefix of at most `limit` tokens.

    With `keep_table` also the table itself: ends and counts, little-endian 32-bit integers, one
    for each piece. One pass without a shuffle.
    """
    more = ", ends binary, counts binary" if keep_table else ""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory(tokenizer)
        inside = process_store(f"inside:{tokenizer}", lambda: WordPrefixes(tokenizer))

        def running() -> RunningCount:
            return process_store(f"running:{tokenizer}", lambda: RunningCount(memory.tokenizer, inside))

        for batch in slices(batches):
            sizes, totals, fits, ends, counts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                table = PrefixCounts(text, memory, inside, running)
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                totals.append(table.total)
                fits.append(len(text) if table.total <= limit else table.fit(limit))
                if keep_table:
                    ends.append(table.ends.astype("<i4").tobytes())
                    counts.append(table.counts.astype("<i4").tobytes())
            columns = {
                "doc_id": batch.column(0),
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_tokens": pa.array(totals, pa.int64()),
                "over_limit": pa.array([t > limit for t in totals], pa.bool_()),
                "fit_chars": pa.array(fits, pa.int64()),
            }
            if keep_table:
                columns |= {"ends": pa.array(ends, pa.binary()), "counts": pa.array(counts, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + more
    return slim(docs, id_col, text_col).mapInArrow(count, schema)
