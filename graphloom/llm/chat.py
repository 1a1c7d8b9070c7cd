"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine reads the turns of a conversation in order. For each it emits the template's text segments, each with a loss flag, and moves to
the role's state; a turn that no transition allows sends it to "broken" for good, which is reported, and the turn is formatted all the
same. The template encloses each turn in control strings. Control strings and escape characters inside texts are escaped: a backslash is doubled, and one
is put after the first character of a control string, so that none is left, and dropping each backslash's own character
gives the text back.

Reading back takes the text of a whole conversation, in pieces cut anywhere, and finds turns and loss spans by the template alone: a turn by the text that begins it, and the end of a slot by the first control string
after it, since none is left inside.

Turns of a conversation are brought together in one task and sorted there by turn, then role, then text; they stream
through it, so memory holds a batch and the running digests however long a conversation is. (A digest over ordered
turns cannot be split.)

Defined results: a null role or text counts as empty; null conversation ids form one conversation; null turns come first; repeated rows are repeated turns; a role that
the template does not know is written with its name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Slot(Enum):
    ROLE = 1
    TEXT = 2


ROLE, TEXT = Slot.ROLE, Slot.TEXT


@dataclass(frozen=True)
class Template:
    """turns: role -> parts, each a control text, ROLE or TEXT; None stands for other roles. loss: roles whose TEXT is learnt. moves: (state, role) -> state."""

    controls: tuple[str, ...]
    turns: dict
    loss: frozenset
    moves: dict
    start: str = "start"
    ends: frozenset = frozenset({"assistant"})


INSTRUCT = Template(
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"),
    turns={
        "system": ("<<SYS>>\n", TEXT, "\n<</SYS>>\n"),
        "user": ("<s>[INST] ", TEXT, " [/INST]"),
        "assistant": (" ", TEXT, " </s>"),
        None: ("[ROLE]", ROLE, "[/ROLE]", TEXT, "</s>"),
    },
    loss=frozenset({"assistant"}),
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
)


#: Segments of a conversation that are joined before they are read back.
POUR = 4096


class Formatter:
    """The machine for one template: escaping, formatting and reading back."""

    def __init__(self, template: Template):
        self.template = template
        self.control = re.compile("|".join(re.escape(c) for c in sorted(template.controls, key=len, reverse=True)))
        for parts in template.turns.values():
            if isinstance(parts[0], Slot) or any(isinstance(p, Slot) and not (isinstance(q, str) and self.control.search(q)) for p, q in zip(parts, (*parts[1:], None), strict=True)):
                raise ValueError("a turn begins with text of the template, and each slot ends before a control string")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        return self.control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def step(self, state: str, role: str) -> str:
        return self.template.moves.get((state, role), "broken")

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn; the flagged segment is the escaped text alone."""
        known = role if role in self.template.turns else None
        flag = role in self.template.loss
        return [(self.escape(role), False) if p is ROLE else (self.escape(text), flag) if p is TEXT else (p, False) for p in self.template.turns[known]]

    def read(self, formatted: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start and stop of the text's span) of each turn of a formatted conversation."""
        reader = Reader(self)
        return [*reader.feed(formatted), *reader.end()]


class Reader:
    """Reads a formatted conversation from pieces; holds the turn that isn't complete yet."""

    def __init__(self, formatter: Formatter):
        self.f = formatter
        self.longest = max(map(len, formatter.template.controls))
        self.text, self.at, self.offset = "", 0, 0  # what is held, where reading stands in it, what was read before it
        self.role, self.part, self.scan = "", -1, 0
        self.found: dict = {}

    def feed(self, piece: str, last: bool = False) -> list[tuple[str, str, int, int]]:
        self.text = self.text[self.at :] + piece
        self.offset, self.scan, self.at = self.offset + self.at, self.scan - self.at, 0
        out = []
        while self._advance(last):
            if self.part == len(self.f.template.turns[self.role]):
                text, start, stop = self.found[TEXT]
                out.append((self.found[ROLE][0] if self.role is None else self.role, text, start, stop))
                self.part, self.found = -1, {}
        return out

    def end(self) -> list[tuple[str, str, int, int]]:
        out = self.feed("", last=True)
        if self.at < len(self.text) or self.part >= 0:
            raise ValueError("not a conversation of this template")
        return out

    def _advance(self, last: bool) -> bool:
        """Reads one part; whether there was one."""
        turns = self.f.template.turns
        if self.part < 0:
            if self.at == len(self.text) or not last and len(self.text) - self.at < max(len(parts[0]) for parts in turns.values()):
                return False
            begun = [role for role, parts in turns.items() if self.text.startswith(parts[0], self.at)]
            if len(begun) != 1:
                raise ValueError("not a turn of this template")
            self.role, self.part = begun[0], 0
        parts = turns[self.role]
        now = parts[self.part]
        if isinstance(now, str):
            if len(self.text) - self.at < len(now):
                return False
            if not self.text.startswith(now, self.at):
                raise ValueError("a turn that doesn't end as the template says")
            self.at += len(now)
        else:
            after = parts[self.part + 1]
            m = self.f.control.search(self.text, max(self.at, self.scan))
            if m is None:
                self.scan = max(self.at, len(self.text) - self.longest)
                return False
            stop = m.start() - self.f.control.search(after).start()
            if stop < self.at:
                raise ValueError("a control string inside a text")
            self.found[now] = (self.f.unescape(self.text[self.at : stop]), self.offset + self.at, self.offset + stop)
            self.at = self.scan = stop
        self.part += 1
        return True


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def segments(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, place, state, part, text, loss: the output, one row per segment, in order of place (of the turn) and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(template)
        now, place, state = object(), 0, template.start
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if conv != now:
                    now, place, state = conv, 0, template.start
                state = f.step(state, role)
                out += [(conv, place, state, k, t, loss) for k, (t, loss) in enumerate(f.segments(role, text))]
                place += 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_()), strict=True)], names=["conv_id", "place", "state", "part", "text", "loss"])

    return _ordered(conversations).mapInArrow(run, "conv_id long, place long, state string, part int, text string, loss boolean")


def digests(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid: read back from each conversation's one text, in which the reader finds the turns and the spans that are learnt.

    valid: every turn was allowed, and the last may end a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(template)
        now, tally, done, held = None, None, [], []

        def told(turns: list[tuple[str, str, int, int]]) -> None:
            for role, text, _, _ in turns:
                tally["state"] = f.step(tally["state"], role)
                tally["turns"] += 1
                tally["all"].update(f"{role}\n{text}\n".encode())
                if role in template.loss:
                    tally["loss_chars"] += len(text)
                    tally["loss"].update(text.encode())

        def pour(last: bool) -> None:
            text = "".join(held)
            held.clear()
            tally["chars"] += len(text)
            told(tally["reader"].feed(text))
            if last:
                told(tally["reader"].end())

        def close() -> None:
            if tally:
                pour(True)
                done.append((now, tally["turns"], tally["all"].hexdigest(), tally["loss_chars"], tally["loss"].hexdigest(), tally["chars"], tally["state"] in template.ends))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 7
            done.clear()
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        for batch in batches:
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if tally is None or conv != now:
                    close()
                    now, tally = conv, {"turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "state": template.start, "reader": Reader(f)}
                held += [t for t, _ in f.segments(role, text)]
                if len(held) > POUR:
                    pour(False)
            yield flush()
        close()
        yield flush()

    return _ordered(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
