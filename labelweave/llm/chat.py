"""Chat formatting with a finite-state machine over roles and a declarative template.

The machine validates the order of turns; the template says what stands before and after each role's
text and whether its text is under the loss. Control strings inside texts are escaped by a backslash
after their first character, and backslashes are doubled, so that the formatted text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import table


@dataclass(frozen=True)
class Turn:
    """What stands around a role's text, and whether that text is under the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A chat format: marks by role, the mark of other roles' names ({role}), and the order of turns."""

    begin: str = "<s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn(" ", " </s>", True)})
    other: Turn = Turn("[ROLE] {role} [/ROLE] ", " [/TURN]")
    controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]")
    #: State and role -> next state; anything else is a fault and leaves the state at the role.
    order: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        return re.sub("|".join(map(re.escape, sorted(self.controls, key=len, reverse=True))), lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text

    def marks(self, role: str) -> Turn:
        if role in self.turns:
            return self.turns[role]
        return Turn(self.other.before.replace("{role}", self.escape(role)), self.other.after, self.other.loss)

    def reader(self) -> re.Pattern:
        """Matches one formatted turn; group r<k> or r (role) and text."""
        own = [f"{re.escape(t.before)}(?P<t{k}>.*?){re.escape(t.after)}" for k, t in enumerate(self.turns.values())]
        other = re.escape(self.other.before).replace(re.escape("{role}"), "(?P<role>.*?)") + "(?P<text>.*?)" + re.escape(self.other.after)
        order = sorted(range(len(own)), key=lambda k: -len([*self.turns.values()][k].before))
        return re.compile("|".join([other, *(own[k] for k in order)]), re.S)


TEMPLATE = Template()


def format_chats(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, turn_no, text, loss, fault): segments of each conversation in order; joined, a conversation's texts are its formatted form.

    rows has conv_id, turn, role and text. Turns go by turn, then role, then text, repeated rows being
    turns of their own; null texts and roles count as empty; rows with a null conv_id are one
    conversation; an empty table gives no rows; other columns are not read. Every turn is formatted;
    `fault` tells on the first segment of a turn what its order violates. Conversations are streamed, so
    one of any length needs the memory of a turn.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, number = None, "start", 0
        for batch in batches:
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            out: list[tuple] = []
            for conv, role, text in zip(ids, roles, texts, strict=True):
                if now is None or now[0] != conv:
                    now, state, number = (conv,), "start", 0
                    out.append((conv, -1, template.begin, False, None))
                role = role or ""
                after = template.order.get((state, role))
                fault = None if after else f"{role or 'no role'} after {state}"
                state, marks, body = after or role or "other", template.marks(role), template.escape(text or "")
                if marks.loss:
                    out += [(conv, number, marks.before, False, fault), (conv, number, body, True, None), (conv, number, marks.after, False, None)]
                else:
                    out.append((conv, number, marks.before + body + marks.after, False, fault))
                number += 1
            columns = [*zip(*out, strict=True)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("conv_id").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.bool_()), pa.array(columns[4], pa.string())], names=["conv_id", "turn_no", "text", "loss", "fault"])

    own = rows.select("conv_id", "turn", "role", "text")
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, turn_no bigint, text string, loss boolean, fault string")


def read_back(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """A row for each conversation of format_chats(), with what its segments hold when they are parsed again.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed), loss_chars and loss_sha256 (of
    the unescaped text under the loss), formatted_chars, faults (turns out of order), complete (it ends
    in a final state). The segments have to come as format_chats() returns them, not shuffled.
    """
    kind, pattern, names = segments.schema["conv_id"].dataType.simpleString(), template.reader(), [*template.turns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, done = None, []

        def fresh(conv) -> dict:
            return {"conv": conv, "buffer": "", "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "loss_chars": 0, "faults": 0, "last": ""}

        def parse(x: dict) -> None:
            while x["buffer"] and (m := pattern.match(x["buffer"])):
                found = {k: v for k, v in m.groupdict().items() if v is not None}
                if "role" in found:
                    role, text = template.unescape(found["role"]), found["text"]
                else:
                    ((k, text),) = found.items()
                    role = names[int(k[1:])]
                x["all"].update(f"{role}\n{template.unescape(text)}\n".encode())
                x["turns"], x["last"], x["buffer"] = x["turns"] + 1, role, x["buffer"][m.end() :]

        def close(x: dict) -> tuple:
            parse(x)
            if x["buffer"]:
                raise ValueError(f"conversation {x['conv']} can't be read back")
            return x["conv"], x["turns"], x["all"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["chars"], x["faults"], x["last"] in template.final

        def emit() -> pa.RecordBatch:
            columns = [*zip(*done, strict=True)]
            kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "faults", "complete"])

        x = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            rows = [*zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_no", "text", "loss", "fault")), strict=True)]
            for k, (conv, number, text, loss, fault) in enumerate(rows):
                if number == -1:
                    if x:
                        done.append(close(x))
                    x = fresh(conv)
                    if text != template.begin:
                        raise ValueError("a conversation has to begin with the template's mark")
                else:
                    x["buffer"] += text
                    if loss:
                        plain = template.unescape(text)
                        x["loss"].update(plain.encode())
                        x["loss_chars"] += len(plain)
                    if k + 1 < len(rows) and rows[k + 1][1] != number:
                        parse(x)
                x["chars"] += len(text)
                x["faults"] += fault is not None
            if done:
                yield emit()
                done = []
        if x:
            done.append(close(x))
            yield emit()

    return segments.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, faults bigint, complete boolean")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    return read_back(format_chats(rows.unionByName(probe)))
