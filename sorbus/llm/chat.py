"""Chat formatting with loss masks aligned to offsets (operator 12).

A conversation is rendered whole: `<s>`, then each turn between the marks of its role (an assistant's text has only `</s>`
behind it, so it follows another mark). It is encoded once, with the offsets of every token; the marks are added tokens, so
no token reaches over a turn's edge. The turns' spans are sorted, and so are the tokens': a binary search gives each token
the first span that ends beyond its start, and it bears loss if it overlaps an assistant's.

Marks inside a text are escaped by a backslash after their first character, and marks that have backslashes there get one
more. Nothing else is changed, and taking one backslash from each such place gives the text back: escape() and unescape().
Roles other than user, assistant and system are written out, escaped too, before their text.

Turns are ordered by turn (null first), then role, then text, so repeated rows stand side by side; each is a turn. A null
text or role is an empty one; rows without a conv_id are one conversation of id null. Other columns than the four are not
read, whatever their names. Texts are whole, of any length. An empty table gives an empty result. A conversation, like a
text, is one value: a task holds one at a time, and nothing else of its group.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.llm.common import map_arrow, prepare, table, texts_of

BEGIN, END = "<s>", "</s>"
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", END)}
ROLE = ("<<ROLE>>", "<</ROLE>>")
END_OF_TEXT = "<|endoftext|>"  # the vocabulary's own added token
CONTROLS = (BEGIN, END, *MARKS["user"], *MARKS["system"], *ROLE, END_OF_TEXT)
REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
PLAIN, ESCAPED = re.compile(rf"([<\[])(\\*)({REST})"), re.compile(rf"([<\[])\\(\\*)({REST})")
TURN = re.compile("|".join(map(re.escape, CONTROLS)))
SCHEMA = "conv_id long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
BYTES = 1 << 20  # characters that are encoded together
HELD: dict[str, object] = {}


def escape(text: str) -> str:
    return PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The conversation as one text, and of each turn's text the span and whether an assistant says it; spans are sorted."""
    out, at, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        before, after = MARKS.get(role) or (ROLE[0] + escape(role) + ROLE[1], END)
        text = escape(text)
        start = at + len(before)
        spans.append((start, start + len(text), role == "assistant"))
        out += [before, text, after]
        at = start + len(text) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation: (role, text)."""
    marks = [(m.start(), m.end(), m.group()) for m in TURN.finditer(formatted)]
    opening = {before: (role, 1) for role, (before, _) in MARKS.items() if before} | {ROLE[0]: (None, 2)}
    turns, k, at = [], 1, len(BEGIN)
    while k < len(marks):
        role, skip = opening.get(marks[k][2], ("assistant", 0)) if marks[k][0] == at else ("assistant", 0)
        if skip == 2:
            role = unescape(formatted[marks[k][1] : marks[k + 1][0]])
        begin = marks[k + skip - 1][1] if skip else at
        close = marks[k + skip]
        turns.append((role, unescape(formatted[begin : close[0]])))
        k, at = k + skip + 1, close[1]
    return turns


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, bool]]) -> np.ndarray:
    """Which tokens overlap a span that bears loss. Each looks up the first such span that ends beyond its start."""
    bearing = np.array([(a, b) for a, b, said in spans if said and b > a], np.int64).reshape(-1, 2)
    if not len(bearing):
        return np.zeros(len(starts), bool)
    k = np.searchsorted(bearing[:, 1], starts, "right")
    return (k < len(bearing)) & (bearing[np.minimum(k, len(bearing) - 1), 0] < ends) & (ends > starts)


def said(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts under the loss mask, unescaped. Tokens that share a character, or touch, are of one text."""
    a, b = starts[loss], ends[loss]
    if not len(a):
        return []
    first = np.flatnonzero(np.append(True, a[1:] > np.maximum.accumulate(b)[:-1]))
    last = np.append(first[1:], len(a)) - 1
    return [unescape(formatted[i:j]) for i, j in zip(a[first].tolist(), np.maximum.accumulate(b)[last].tolist(), strict=True)]


def tokenizer(path: str):
    if path not in HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        tok = Tokenizer.from_file(path)
        tok.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROLS if c != END_OF_TEXT])
        HELD[path] = tok
    return HELD[path]


def format_chats(rows: DataFrame, path: str) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): its turns' number, its rendered text, and the ids, offsets (in
    code points) and loss of its tokens by the tokenizer file `path`, in which the marks take the ids after the last."""
    prepare(rows.sparkSession)

    def encoded(held: list[tuple]) -> pa.RecordBatch:
        tok, n, text, ids, starts, ends, loss = tokenizer(path), [], [], [], [], [], []
        made = [render(turns) for _, turns in held]
        for (_, turns), (formatted, spans), e in zip(held, made, tok.encode_batch([m[0] for m in made], add_special_tokens=False), strict=True):
            at = np.array(e.offsets, np.int32).reshape(-1, 2)
            n.append(len(turns))
            text.append(formatted)
            ids.append(np.array(e.ids, np.int32))
            starts.append(at[:, 0])
            ends.append(at[:, 1])
            loss.append(loss_mask(at[:, 0], at[:, 1], spans))
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in held], pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string()), *[pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, ends)], pa.array(loss, pa.list_(pa.bool_()))],
            names=["conv_id", "n_turns", "formatted", "ids", "starts", "ends", "loss"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole conversations, and at the end the one that is being read
        size = 0
        for batch in batches:
            for c, role, text in zip(batch.column("conv_id").to_pylist(), texts_of(batch.column("role")), texts_of(batch.column("text")), strict=True):
                if not held or held[-1][0] != c:
                    if size >= BYTES:
                        yield encoded(held)
                        held, size = [], 0
                    held.append((c, []))
                held[-1][1].append((role, text))
                size += len(text) + 64
        if held:
            yield encoded(held)

    laid = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return laid.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def digests(chats: DataFrame) -> DataFrame:
    """What format_chats' result says when it is read back: turns from the rendered text, loss from tokens and mask."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        arrays = {c: batch.column(c) for c in ("starts", "ends", "loss")}
        for i, (c, formatted) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True)):
            turns = parse(formatted)
            starts, ends, loss = (arrays[c][i].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))
            texts = "".join(said(formatted, starts, ends, loss))
            h = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
            rows.append((c, len(turns), h.hexdigest(), len(texts), hashlib.sha256(texts.encode()).hexdigest(), len(formatted)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(chats.select("conv_id", "formatted", "starts", "ends", "loss"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of the marks themselves, formatted, encoded, masked and read back."""
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    marks = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = rows.union(spark.createDataFrame(marks, "conv_id long, turn long, role string, text string"))
    return digests(format_chats(rows, public_tokenizers.path("byte_bpe_50k.json")))


def quoted(text: str) -> str:
    return text.replace("'", "''")


ESCAPE_SQL = rf"regexp_replace(text, '{quoted(PLAIN.pattern)}', '\1\\\2\3', 'g')"
CHAT_SQL = rf"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length({ESCAPE_SQL}) + case role when 'user' then 13 when 'system' then 15 when 'assistant' then 4
  else 21 + length({ESCAPE_SQL.replace("text", "role")}) end as chars from r),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
  coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '') as loss, sum(chars) + 3 as chars from e group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, chars::bigint as formatted_chars from g
"""
