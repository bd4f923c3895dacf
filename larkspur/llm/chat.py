"""Prefix-target expansion of conversations into training examples."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import rows_of

EXAMPLES = "conv_id long, example long, target_turn long, text string, loss_start long, loss_end long, last boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Characters of examples that a task gathers before it hands them on.
LOT_CHARS = 4_000_000


@dataclass(frozen=True)
class Template:
    """Marks of a bracketed chat template. Replies stand bare and end with `</s>`; every other role has its own marks.

    Inside texts a control string gets one more backslash behind its first character, and loses one when read, so
    any text comes back as it was and no text can hold a control string.
    """

    begin: str = "<s>"
    end: str = "</s>"
    marks: tuple[tuple[str, str, str], ...] = (("user", "[INST] ", " [/INST]"), ("system", "[SYS] ", " [/SYS]"))
    other: tuple[str, str, str] = ("[ROLE:", "] ", " [/ROLE]")

    _control = r"(/?(?:s>|INST\]|SYS\]|ROLE[:\]]))"

    def escape(self, text: str) -> str:
        return re.sub(r"([<\[])(\\*)" + self._control, r"\1\2\\\3", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"([<\[])(\\*)\\" + self._control, r"\1\2\3", text)

    def turn(self, role: str | None, text: str) -> tuple[str, str, str]:
        """What stands before the text, the escaped text, and what stands behind it."""
        if role == "assistant":
            return "", self.escape(text), self.end
        for name, left, right in self.marks:
            if role == name:
                return left, self.escape(text), right
        left, middle, right = self.other
        # a role is written in hexadecimal, so that it holds no mark; a null role has a name of its own
        return left + ("null" if role is None else role.encode().hex()) + middle, self.escape(text), right

    def turns(self, text: str) -> Iterator[tuple[str | None, str]]:
        """The (role, text) pairs of a formatted text."""
        at = len(self.begin)
        while at < len(text):
            for role, left, right in self.marks:
                if text.startswith(left, at):
                    start = at + len(left)
                    break
            else:
                if text.startswith(self.other[0], at):
                    start = text.index(self.other[1], at) + len(self.other[1])
                    named, right = text[at + len(self.other[0]) : start - len(self.other[1])], self.other[2]
                    role = None if named == "null" else bytes.fromhex(named).decode()
                else:
                    role, start, right = "assistant", at, self.end
            stop = text.index(right, start)
            yield role, self.unescape(text[start:stop])
            at = stop + len(right)


def expand_replies(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One example for every assistant turn: all turns before it as context, and only its text trainable.

    loss_start and loss_end are code points of `text`. A conversation that doesn't end with a reply has one more
    example without a target (null target_turn, empty span), so that each conversation's last example holds all of
    its turns. Rows are dealt by conv_id and read as a sorted stream; a task holds one conversation's text.

    Turns are in order of (turn, role, text), nulls first; null texts count as empty; null roles come back null;
    rows with a null conv_id form one conversation. Repeated rows are turns of their own. An empty table gives no
    rows. Extra columns are ignored.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0

        def handed() -> pa.RecordBatch:
            nonlocal chars
            cols = zip(*out, strict=True) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in EXAMPLES.split(", ")])
            out.clear()
            chars = 0
            return got

        def finish() -> None:
            """Ends the conversation: its last example is marked, or made without a target."""
            nonlocal pending
            if pending is not None:
                out.append((*pending, True))
            elif parts:
                out.append((conv, n, None, "".join(parts), size, size, True))
            pending = None

        conv, parts, size, n, pending, begun = None, [], 0, 0, None, False
        for batch in batches:
            for c, turn, role, text in rows_of(batch, "conv_id", "turn", "role", "text"):
                if not begun or c != conv:
                    finish()
                    conv, parts, size, n, begun = c, [template.begin], len(template.begin), 0, True
                if pending is not None:
                    out.append((*pending, False))
                    pending = None
                left, body, right = template.turn(role, text or "")
                parts.append(left + body + right)
                start = size + len(left)
                size += len(left) + len(body) + len(right)
                if role == "assistant":
                    parts = ["".join(parts)]
                    pending = (conv, n, turn, parts[0], start, start + len(body))
                    n, chars = n + 1, chars + size
                if chars > LOT_CHARS:
                    yield handed()
        finish()
        yield handed()

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(expand, EXAMPLES)


def digest_examples(examples: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads formatted examples back, in the order that expand_replies() gives them, to one row of digests a conversation."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, loss_chars, chars = hashlib.sha256(), 0, 0
        for batch in batches:
            out = []
            for conv, text, start, end, last in rows_of(batch, "conv_id", "text", "loss_start", "loss_end", "last"):
                trained = template.unescape(text[start:end])
                loss.update(trained.encode())
                loss_chars += len(trained)
                chars += len(text)
                if last:
                    turns, n = hashlib.sha256(), 0
                    for role, said in template.turns(text):
                        turns.update(f"{role or ''}\n{said}\n".encode())
                        n += 1
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    loss, loss_chars, chars = hashlib.sha256(), 0, 0
            cols = zip(*out, strict=True) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in DIGESTS.split(", ")])

    return examples.mapInArrow(digest, DIGESTS)
