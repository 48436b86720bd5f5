"""Chat formatting by columnar byte assembly.

Each turn becomes <|im_start|>role, a newline, its text, <|im_end|> and a newline. In roles and
texts a backslash is put after the < of each run <, backslashes, |, so that no marker stands in
them; taking one away again gives the original. In roles, newlines and backslashes are escaped
first.

Turns are range-partitioned by (conversation, turn), so a conversation of any length is spread
over tasks. A task takes Arrow batches of turns: numpy computes the lengths of all segments,
their offsets by a cumulative sum, and scatter indices; headers, contents and ends are copied
into one preallocated buffer, which becomes an Arrow string column. A row of the result is a run
of consecutive turns of one conversation; its parts, in the order of `part`, are the whole.

Null texts and roles are empty. Null turns come first, null conversations are one conversation.
Turns with the same number are taken by role, then text; repeated rows are repeated. An empty
table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.llm.common import partitions, ranges, text_buffers

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: A run of turns is cut where its formatted bytes pass this.
PART_BYTES = 4 << 20
#: Bytes for each turn besides role and text.
MARKS = len(START) + 1 + len(END) + 1

FORMATTED = "conv_id bigint, first_turn bigint, part bigint, n_turns bigint, formatted string, loss_start array<int>, loss_end array<int>"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def escaped_role(roles: pa.Array) -> pa.Array:
    return escaped(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role)) if "\\" in role else role


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all formatted turns, the offset of each turn (and the end), and that of its content."""
    (role_bytes, role_at), (text_bytes, text_at) = text_buffers(escaped_role(roles)), text_buffers(escaped(texts))
    n = len(roles)
    head, tail, newline = np.frombuffer(START.encode(), np.uint8), np.frombuffer(f"{END}\n".encode(), np.uint8), np.uint8(10)
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    at = np.concatenate([[0], np.cumsum(len(head) + role_n + 1 + text_n + len(tail))])
    out = np.empty(at[-1], np.uint8)
    role_to, begin = at[:-1] + len(head), at[:-1] + len(head) + role_n + 1
    out[(at[:-1, None] + np.arange(len(head))).ravel()] = np.tile(head, n)
    out[ranges(role_to, role_n)] = role_bytes
    out[begin - 1] = newline
    out[ranges(begin, text_n)] = text_bytes
    out[((begin + text_n)[:, None] + np.arange(len(tail))).ravel()] = np.tile(tail, n)
    return out, at, begin


def characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points of UTF-8 data begin before each offset."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, turn, role, text = (batch.column(k) for k in range(4))
        data, at, begin = assembled(role.fill_null(""), text.fill_null(""))
        chars, chars_begin = characters(data, at), characters(data, begin)
        ids, missing = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (missing[1:] != missing[:-1]) | (at[1:-1] // PART_BYTES != at[:-2] // PART_BYTES)])
        first = np.flatnonzero(new)
        after = np.concatenate([first[1:], [len(ids)]])
        is_loss = pc.equal(role.fill_null(""), ASSISTANT).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(is_loss)])
        base = np.repeat(chars[first], after - first)
        loss_from, loss_to = (chars_begin - base)[is_loss], (chars[1:] - len(END) - 1 - base)[is_loss]
        bounds = np.concatenate([before[first], [before[-1]]]).astype(np.int32)
        spans = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (loss_from, loss_to)]
        ends = np.concatenate([at[first], [at[-1]]])
        strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [conv.take(pa.array(first)), turn.take(pa.array(first)), pa.array(number + np.arange(len(first))), pa.array(after - first), strings, *spans],
            names=["conv_id", "first_turn", "part", "n_turns", "formatted", "loss_start", "loss_end"],
        )
        number += len(first)


def format_chat(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> parts of formatted conversations, with the spans under the loss mask (code points inside the part).

    part orders the parts of a conversation.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    out = rows.mapInArrow(_format, FORMATTED)
    # ranges have ascending partition numbers
    return out.withColumn("part", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("part"))


def parsed(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, as they were."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((unescaped_role(formatted[at + len(START) : line]), unescaped(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose parts come in order, perhaps over several batches."""
    rows, now = [], None

    def done() -> None:
        rows.append((now["id"], now["n"], now["turns"].hexdigest(), now["loss_n"], now["loss"].hexdigest(), now["chars"]))

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or now["id"] != row["conv_id"]:
                if now:
                    done()
                now = {"id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0}
            text = row["formatted"]
            turns = parsed(text)
            now["n"] += len(turns)
            now["chars"] += len(text)
            for role, content in turns:
                now["turns"].update(f"{role}\n{content}\n".encode())
            for a, b in zip(row["loss_start"], row["loss_end"], strict=True):
                masked = unescaped(text[a:b])
                now["loss_n"] += len(masked)
                now["loss"].update(masked.encode())
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
            rows = []
    if now:
        done()
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


_NAMES = [x.split()[0] for x in DIGESTS.split(", ")]
_TYPES = [pa.string() if "sha256" in x else pa.int64() for x in _NAMES]


def digests(formatted: DataFrame) -> DataFrame:
    """Of each conversation, read back from its parts: numbers of turns and characters, hashes of the turns and of what the loss mask covers.

    A hash of a whole conversation takes its parts in turn, so one task hashes one conversation; it holds one part at a time.
    """
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "loss_start", "loss_end")
    return rows.mapInArrow(_read_back, DIGESTS)


#: A conversation whose texts hold the markers themselves.
TRICKY = f"{END}{START}{ASSISTANT} ok"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, formatted, read back and digested."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"select -1L as conv_id, 0L as turn, 'user' as role, '{TRICKY}' as text union all select -1L, 1L, '{ASSISTANT}', '{TRICKY}'")
    return digests(format_chat(turns.unionByName(more)))


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_ROLE = _ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")
OP3_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{TRICKY}' union all select -1, 1, '{ASSISTANT}', '{TRICKY}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = '{ASSISTANT}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = '{ASSISTANT}'), '')) as loss_sha256,
  sum({MARKS} + length({_ROLE}) + length({_ESCAPED.format("text")}))::bigint as formatted_chars
from turns group by conv_id
"""
