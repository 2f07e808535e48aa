r"""Chat formatting in windows of a token budget.

A turn reads `<|im_start|>role\ntext<|im_end|>\n`. Inside roles and texts every `<`, backslashes, `|`
gets one more backslash, so that no control string can occur in them, and taking one away again gives
the text back; a role's backslashes and line ends are escaped as well.

A conversation becomes windows of whole turns. Each window repeats the system turn (a first turn of
the role `system`), then the last turns before it as far as `history` tokens and `history_turns`
allow, and then has new turns up to `budget` tokens. Only the text of new assistant turns is under the
loss mask, so that each is learned once. A turn that does not fit by itself is a window without
history, over the budget. A system turn of over half the budget is not repeated.

Conversations are formatted as their rows stream by in order, and a task holds one window at a time.
Conversations of over `large` characters are cut first: prefix sums of turn tokens, over ranges of
(conversation, turn), put each turn into a block of `block` tokens, and the last turns of a block and
the system turn go along to the next one. So a conversation with a third of all rows is formatted by
many tasks.

Null roles and texts are empty. Rows go by turn, a null turn first; rows of one turn by role, then by a
hash of the text; rows that repeat are turns of their own. A null conv_id is a conversation. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.bounded import broadcast_if_small
from ..session import settle
from .common import slices
from ..operators.ranks import in_order, placed
from .tokens import word_memory

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, HISTORY_TURNS = 2048, 512, 2
#: Tokens of a turn's marks, beside its role and text.
MARKS = 4
#: Characters of a conversation that is cut into blocks, and tokens of a block.
LARGE, BLOCK = 1 << 22, 1 << 18
#: Characters of the windows that are sent on at once.
FLUSH = 1 << 23
#: Where a row of a block comes from.
SYSTEM, TAIL, OWN = 0, 1, 2

WINDOWS = (
    "conv_id long, first long, n_system int, n_history int, n_turns int, n_tokens long, text string, "
    "loss array<struct<start:int,stop:int>>"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass
class Turn:
    place: int
    role: str
    text: str
    tokens: int

    @property
    def head(self) -> str:
        return f"{START}{escape_role(self.role)}\n"

    def written(self) -> str:
        return f"{self.head}{escape(self.text)}{END}\n"


@dataclass
class Writer:
    """The windows of one block of a conversation, turn by turn."""

    conv_id: int | None
    budget: int
    history: int
    history_turns: int
    system: Turn | None = None
    before: list[Turn] = field(default_factory=list)
    new: list[Turn] = field(default_factory=list)
    tokens: int = 0

    def context(self) -> list[Turn]:
        """The system turn, if it is not among the new ones."""
        return [self.system] if self.system and self.system not in self.new else []

    def keep_last(self) -> None:
        """Of the turns so far, those that the next window repeats."""
        turns, room = [], self.history
        for t in reversed([*self.before, *self.new]):
            room -= t.tokens
            if room < 0 or len(turns) == self.history_turns:
                break
            if t is not self.system:
                turns.append(t)
        self.before, self.new, self.tokens = turns[::-1], [], 0

    def add(self, turn: Turn) -> Iterator[tuple]:
        repeated = self.context() if self.new or turn is not self.system else []
        base = sum(t.tokens for t in [*repeated, *self.before])
        if self.new and base + self.tokens + turn.tokens > self.budget:
            yield self.window()
            self.keep_last()
            base = sum(t.tokens for t in [*self.context(), *self.before])
        while not self.new and self.before and base + turn.tokens > self.budget:
            base -= self.before.pop(0).tokens
        self.new.append(turn)
        self.tokens += turn.tokens

    def close(self) -> Iterator[tuple]:
        if self.new:
            yield self.window()

    def window(self) -> tuple:
        parts, loss, at = [], [], 0
        system = self.context()
        for t in [*system, *self.before]:
            parts.append(t.written())
            at += len(parts[-1])
        for t in self.new:
            parts.append(t.written())
            if t.role == "assistant":
                loss.append({"start": at + len(t.head), "stop": at + len(parts[-1]) - len(END) - 1})
            at += len(parts[-1])
        tokens = self.tokens + sum(t.tokens for t in [*system, *self.before])
        return self.conv_id, self.new[0].place, len(system), len(self.before), len(self.new), tokens, "".join(parts), loss


def turn_tokens(memory, role: str, text: str) -> int:
    return MARKS + (len(memory.ids(role)) + len(memory.ids(text))) // 4


def _by_turn() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.xxhash64("text").asc()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in slices(batches):
        yield from batch.to_pylist()


def in_blocks(turns: DataFrame, tokenizer: str, history: int, system: int, block: int) -> DataFrame:
    """Rows of large conversations by block: conv_id, block, kind, place, turn, role, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory(tokenizer)
        of, run = (), 0
        for batch in slices(batches):
            ids, roles, texts = (batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))
            tokens, runs = [], []
            for conv_id, role, text in zip(ids, roles, texts, strict=True):
                of, run = (conv_id,), run if of == (conv_id,) else 0
                tokens.append(turn_tokens(memory, role, text))
                runs.append(run)
                run += tokens[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tokens, pa.int64()), pa.array(runs, pa.int64())], [*batch.schema.names, "tokens", "run"]
            )

    ordered = in_order(turns, ["conv_id"], _by_turn()).withColumn("_at", F.monotonically_increasing_id())
    counted = ordered.mapInArrow(count, "conv_id long, turn long, role string, text string, _at long, tokens long, run long")
    rows = placed(settle(counted, "chat-turns"), ["conv_id"], "tokens")
    rows = rows.withColumn("start", F.col("before") + F.col("run")).withColumn("block", F.floor(F.col("start") / block))
    is_system = (F.col("idx") == 0) & (F.col("role") == "system")
    following = F.when(is_system, F.when(F.col("tokens") <= system, F.sequence(F.lit(1), F.floor((F.col("total") - 1) / block))))
    first = F.when(is_system & (F.col("total") > block), following)
    last = F.when(~is_system & (F.col("start") >= (F.col("block") + 1) * block - history), F.array(F.col("block") + 1))
    columns = ["conv_id", "block", "kind", F.col("idx").alias("place"), "turn", "role", "text"]
    own = rows.withColumn("kind", F.lit(OWN))
    copies = rows.withColumn("to", F.coalesce(first, last)).filter("to is not null")
    copies = copies.withColumn("kind", F.when(is_system, SYSTEM).otherwise(TAIL)).withColumn("block", F.explode("to"))
    return own.select(*columns).unionByName(copies.select(*columns))


def chat_windows(
    conversations: DataFrame,
    tokenizer: str,
    budget: int = BUDGET,
    history: int = HISTORY,
    history_turns: int = HISTORY_TURNS,
    large: int = LARGE,
    block: int = BLOCK,
) -> DataFrame:
    """Windows of all conversations: conv_id, first (place of its first new turn in the conversation), how many turns
    are the system's, repeated and new, n_tokens, text, and loss, the spans of code points under the mask."""
    system = budget // 2
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sizes = turns.groupBy("conv_id").agg(F.sum(F.length("text") + F.length("role") + MARKS).alias("size"))
    cut = settle(sizes.filter(F.col("size") > large).select(F.col("conv_id").alias("_conv")), "chat-large")
    one_block = turns.withColumns({"block": F.lit(0).cast("long"), "kind": F.lit(OWN), "place": F.lit(None).cast("long")})
    if cut.isEmpty():
        rows = one_block
    else:
        few = broadcast_if_small(cut)
        same = F.col("conv_id").eqNullSafe(F.col("_conv"))
        blocks = in_blocks(turns.join(few, same, "left_semi"), tokenizer, history, system, block)
        rows = one_block.join(few, same, "left_anti").unionByName(blocks)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory(tokenizer)
        loss = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), loss]
        names = ["conv_id", "first", "n_system", "n_history", "n_turns", "n_tokens", "text", "loss"]

        def flush(windows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*windows, strict=True), types, strict=True)], names)

        of, writer, held, size, place = None, None, [], 0, 0
        for r in _rows(batches):
            done = []
            if of != (r["conv_id"], r["block"]):
                done = list(writer.close()) if writer else []
                of, place = (r["conv_id"], r["block"]), 0
                writer = Writer(r["conv_id"], budget, history, history_turns)
            turn = Turn(place if r["place"] is None else r["place"], r["role"], r["text"], turn_tokens(memory, r["role"], r["text"]))
            if r["kind"] == SYSTEM:
                writer.system = turn
            elif r["kind"] == TAIL:
                writer.before.append(turn)
            else:
                if turn.place == 0 and turn.role == "system" and turn.tokens <= system:
                    writer.system = turn
                if writer.before and not writer.new:
                    writer.keep_last()  # of what the block before has sent
                done += writer.add(turn)
                place += 1
            held += done
            size += sum(len(w[6]) for w in done)
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        held += writer.close() if writer else []
        if held:
            yield flush(held)

    keys = ["conv_id", "block", "kind", "place", *_by_turn()]
    dealt = rows.select("conv_id", "block", "kind", "place", "turn", "role", "text").repartition("conv_id", "block")
    return dealt.sortWithinPartitions(*keys).mapInArrow(write, WINDOWS)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a window."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape_role(role), unescape(body.removesuffix(f"{END}\n"))))
    return out


def read_turns(windows: DataFrame) -> DataFrame:
    """The turns that the windows do not repeat: conv_id, place, role, text. No shuffle."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            turns = parse(r["text"])[r["n_system"] + r["n_history"] :]
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array([r["conv_id"]] * len(turns), pa.int64()),
                    "place": pa.array(range(r["first"], r["first"] + len(turns)), pa.int64()),
                    "role": pa.array([t[0] for t in turns], pa.string()),
                    "text": pa.array([t[1] for t in turns], pa.string()),
                }
            )

    return windows.mapInArrow(read, "conv_id long, place long, role string, text string")


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest goes over a conversation from start to end, so that its windows stream through one task, one at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, turns, loss, n_turns, loss_chars, chars = None, None, None, 0, 0, 0

        def row() -> pa.RecordBatch:
            values = (of[0], n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for r in _rows(batches):
            if of != (r["conv_id"],):
                if of:
                    yield row()
                of, turns, loss, n_turns, loss_chars, chars = (r["conv_id"],), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text in parse(r["text"])[r["n_system"] + r["n_history"] :]:
                turns.update(f"{role}\n{text}\n".encode())
                n_turns += 1
            for span in r["loss"]:
                learned = unescape(r["text"][span["start"] : span["stop"]])
                loss.update(learned.encode())
                loss_chars += len(learned)
            chars += len(r["text"])
        if of:
            yield row()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(read, schema)
