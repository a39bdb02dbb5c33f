"""Chat formatting from a declarative template.

A template names the strings that open and close a turn, further control strings, the roles under the loss, and a
table of which role may follow which. A finite-state machine over the roles of a conversation checks each step
against that table while segments are emitted: opening, body, closing, each with its loss flag. A turn that may not
stand where it stands is emitted all the same and named in ``problem``; the machine goes on from its role.

Control strings inside roles and texts are escaped: backslashes are doubled and a backslash goes after the first
character of each control string, wherever one starts. So a formatted text holds control strings only where the
template put them, and taking the backslashes away gives the texts back.

The result is a row a turn; a conversation's text is its rows' texts in order. Turns stream through tasks in order, so
a conversation of any length needs no more memory than a batch. Null texts and roles count as empty; turns of one
number are ordered by role, then text; null turn numbers come first; null conversation ids form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

START, ANY = "^", "*"


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    open: tuple[str, str] = ("<|role:", "|>")  # around the role
    close: str = "<|end|>"
    controls: tuple[str, ...] = ("</s>", "[INST]", "[/INST]")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    loss_on_close: bool = False
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {START: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user", "tool"}), "tool": frozenset({"assistant"})})

    @property
    def control_strings(self) -> tuple[str, ...]:
        return tuple(c for c in (self.begin, *self.open, self.close, *self.controls) if c)

    def __post_init__(self) -> None:
        if any(len(c) < 2 or "\\" in c for c in self.control_strings):
            raise ValueError("control strings have two characters or more and no backslash")

    def escape(self, text: str) -> str:
        starts = "|".join(map(re.escape, self.control_strings))
        return re.sub(rf"(?s)(?=(?:{starts}))(.)", r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"(?s)\\(.)", r"\1", text)

    def step(self, state: str, role: str) -> tuple[str, str | None]:
        """The machine's next state, and what is wrong with the step."""
        allowed = self.follows.get(state, frozenset())
        if role in allowed or ANY in allowed:
            return role, None
        return role, f"{role or 'no role'} after {'the start' if state == START else state or 'no role'}"

    def segments(self, first: bool, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn."""
        loss = role in self.loss_roles
        head = (self.begin if first else "") + self.open[0] + self.escape(role) + self.open[1]
        return [(head, False), (self.escape(text), loss), (self.close, loss and self.loss_on_close)]

    def parse(self, text: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        body = text.removeprefix(self.begin)
        if not (body.startswith(self.open[0]) and body.endswith(self.close)):
            raise ValueError("no formatted turn")
        role, _, rest = body[len(self.open[0]) :].partition(self.open[1])
        return self.unescape(role), self.unescape(rest[: len(rest) - len(self.close)])


_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FORMATTED = "conv long, at long, text string, loss array<struct<start:int,end:int>>, problem string"


def format_turns(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, text, loss, problem): a row a turn, rows of a conversation together and in order; loss has [start, end) code points."""
    template = template or Template()
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    conv = F.coalesce(F.col(f"`{conv_col}`").cast("long"), F.lit(C.NULL_ID))
    rows = turns.select(conv.alias("conv"), F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    ordered = rows.repartition(C.partitions(turns.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, at = None, START, 0
        for b in batches:
            out: list[tuple] = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if conv != current:
                    current, state, at = conv, START, 0
                state, problem = template.step(state, role)
                parts, loss, size = template.segments(at == 0, role, text), [], 0
                for piece, flag in parts:
                    if flag and piece:
                        loss.append({"start": size, "end": size + len(piece)})
                    size += len(piece)
                out.append((conv, at, "".join(p for p, _ in parts), loss, problem))
                at += 1
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), _LOSS, pa.string()), strict=True)], ["conv", "at", "text", "loss", "problem"])

    return C.mapped(ordered.select("conv", "role", "text"), run, FORMATTED, 2048)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, problems) from the rows of :func:`format_turns`, as they stand."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        out: list[dict] = []

        def rows() -> pa.RecordBatch:
            done = [{k: v.hexdigest() if k.endswith("sha256") else v for k, v in x.items()} for x in out]
            out.clear()
            types = {"conv": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "problems": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in types.items()], list(types))

        for b in batches:
            for conv, text, loss, problem in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv", "text", "loss", "problem")], strict=True):
                if state is None or state["conv"] != conv:
                    if state:
                        out.append(state)
                    state = {"conv": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "problems": 0}
                role, body = template.parse(text)
                under = template.unescape("".join(text[s["start"] : s["end"]] for s in loss))
                state["n_turns"] += 1
                state["turns_sha256"].update(f"{role}\n{body}\n".encode())
                state["loss_chars"] += len(under)
                state["loss_sha256"].update(under.encode())
                state["formatted_chars"] += len(text)
                state["problems"] += problem is not None
            if out:
                yield rows()
        if state:
            out.append(state)
            yield rows()

    return formatted.select("conv", "text", "loss", "problem").mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, problems long")


_OWN = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", _OWN), (-7, 1, "assistant", _OWN)], "conv_id long, turn long, role string, text string")
    found = read_back(format_turns(turns.unionByName(own)))
    return found.select(C.plain_id("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _oracle() -> str:
    t = Template()
    count = lambda c, s: f"(length({s}) - length(replace({s}, '{c}', ''))) // {len(c)}"
    size = lambda s: " + ".join([f"length({s})", *[count(c, s) for c in ("\\", *t.control_strings)]])
    fixed = len(t.open[0] + t.open[1] + t.close)
    return f"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_OWN}' UNION ALL SELECT -7, 1, 'assistant', '{_OWN}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST({len(t.begin)} + sum({fixed} + {size('role')} + {size('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


ORACLE = _oracle()
