"""Chat formatting with a compiled template, and reading the formatted text back.

Conversations are dealt by id and sorted by turn; each task renders them one after another through the
lazy closures of ``chat_template`` and writes parts of bounded size with the spans under the loss mask, so a
conversation that holds a third of all turns needs no more memory than another (its digests are sequential,
so its turns pass through one task as a stream).

Control strings inside a role or text are escaped reversibly: a backslash doubles and ``<|`` gets a backslash
inside, so ``<|`` stands only where the template put it.

Defined cases: null text and role are empty; null turns come first, ties are ordered by role, then text;
a null conv_id is a conversation of its own; repeated rows are turns of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.chat_template import compile_template
from switchyard.llm.common import arrow_pass, partitions

START, END = "<|im_start|>", "<|im_end|>\n"
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | header }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m['text'] | escape }}{% endif %}<|im_end|>{{ '\\n' }}{% endfor %}"
)
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def header(role: str) -> str:
    return escape(role).replace("\n", "\\n")


BACK = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return BACK.sub(r"\1", text) if "\\" in text else text


def unheader(role: str) -> str:
    return BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


FILTERS = {"escape": escape, "header": header, "trim": str.strip}
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _writer(template: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        done: list[tuple] = []
        held = 0
        names = ["conv_id", "part", "text", "spans"]
        kinds = [pa.int64(), pa.int64(), pa.string(), SPANS]

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
            done.clear()
            return out

        for conv_id, turns in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in turns)
            part, size, texts, spans = 0, 0, [], []
            for piece, marked in render({"messages": messages}):
                if marked:
                    spans.append({"start": size, "end": size + len(piece)})
                texts.append(piece)
                size += len(piece)
                if size >= PART_CHARS:
                    done.append((conv_id, part, "".join(texts), spans))
                    part, size, texts, spans = part + 1, 0, [], []
                    yield batch_of()
                    held = 0
            done.append((conv_id, part, "".join(texts), spans))
            held += size
            if len(done) >= 512 or held >= PART_CHARS:
                yield batch_of()
                held = 0
        if done:
            yield batch_of()

    return work


def format_conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: str = TEMPLATE,
) -> DataFrame:
    """conv_id, part, text, spans (under the loss mask, within the part): parts stand in order in a partition."""
    compile_template(template, FILTERS)  # a bad template fails here, not in a task
    plain = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"),
    )
    dealt = plain.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow_pass(
        dealt.select("conv_id", "role", "text"), _writer(template),
        "conv_id long, part long, text string, spans array<struct<start: bigint, end: bigint>>",
    )


class Reader:
    """Turns and loss text of one conversation, from formatted text that arrives in parts."""

    def __init__(self):
        self.buffer, self.turns, self.loss_chars = "", 0, 0
        self.turn_hash, self.loss_hash, self.chars = hashlib.sha256(), hashlib.sha256(), 0

    def feed(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for s in spans:
            said = unescape(text[s["start"] : s["end"]])
            self.loss_chars += len(said)
            self.loss_hash.update(said.encode())
        text, at = self.buffer + text, 0
        while (end := text.find(END, at)) >= 0:
            role, _, body = text[at + len(START) : end].partition("\n")
            if not text.startswith(START, at):
                raise ValueError("a turn does not begin with its control string")
            self.turn_hash.update(f"{unheader(role)}\n{unescape(body)}\n".encode())
            self.turns += 1
            at = end + len(END)
        self.buffer = text[at:]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
        done.clear()
        return out

    for conv_id, parts in itertools.groupby(_rows(batches), key=lambda r: r[0]):
        reader = Reader()
        for _, _, text, spans in parts:
            reader.feed(text, spans)
        if reader.buffer:
            raise ValueError("the formatted text does not end with a whole turn")
        done.append((conv_id, reader.turns, reader.turn_hash.hexdigest(), reader.loss_chars,
                     reader.loss_hash.hexdigest(), reader.chars))
        if len(done) >= 1024:
            yield batch_of()
    if done:
        yield batch_of()


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from the output of ``format_conversations``, as it was written."""
    return arrow_pass(
        formatted, _reader,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
