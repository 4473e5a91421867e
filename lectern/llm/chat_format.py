"""Chat formatting over reply trees.

Messages name the message they answer.  Iterated self-joins with doubling steps
(parent, parent's parent, and so on) give every message its distance from the
root and the score of its whole branch in log2(depth) rounds; branches are
ranked by their mean message score, and the paths of the chosen leaves are
enumerated through the same jumps.  Each path becomes one conversation: one
marked turn a message, with control strings inside texts and roles escaped
reversibly, and a mask over the assistant's texts, which a loss may count.

Defined cases: a null text or role is empty; a parent that is not there makes a
root; messages on or below a cycle have no root and no path; ties in score go to
the smaller leaf id; repeated messages of one id each answer and are answered,
so ids should be unique (the query numbers its rows); an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import stored

START, STOP = "<|im_start|>", "<|im_end|>"
#: Strings that must not stand in a formatted text unescaped: the template's own and other templates'.
CONTROL = (START, STOP, "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MASK = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(f"{re.escape(START)}(.*?)\n(.*?){re.escape(STOP)}\n", re.S)


def escape(text: str) -> str:
    """Doubles backslashes, and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    """A role also stays on its line: its line ends become a backslash before the letter n."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"n": "\n", "\\": "\\"}.get(m[1] or "", ""), role)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the stretches of code points under the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, STOP, "\n"]
        at += len(head) + len(body) + len(STOP) + 1
    return "".join(parts), mask


def read_back(conversation: str) -> list[tuple[str, str]]:
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(conversation)]


def jumps(messages: DataFrame) -> list[DataFrame]:
    """Tables conv, msg, up (2^k messages above), total and length of the stretch below ``up``; the last has no ``up`` left."""
    parents = messages.select(F.col("conv").alias("_c"), F.col("msg").alias("_p")).distinct()
    first = messages.join(parents, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("parent") == F.col("_p")), "left").select("conv", "msg", F.col("_p").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length"))
    found = [stored(first, "jumps")]
    rounds = math.ceil(math.log2(max(2, found[0].count()))) + 1
    while found[-1].filter("up IS NOT NULL").limit(1).count() and len(found) <= rounds:
        low, high = found[-1].alias("low"), found[-1].alias("high")
        joined = low.join(high, F.col("low.conv").eqNullSafe(F.col("high.conv")) & (F.col("low.up") == F.col("high.msg")), "left")
        added = [(F.col(f"low.{k}") + F.coalesce(F.col(f"high.{k}"), F.lit(0))).alias(k) for k in ("total", "length")]
        found.append(stored(joined.select("low.conv", "low.msg", "high.up", *added), "jumps"))
    return found


def branches(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """conv, branch (1 is best), turns: the messages of each chosen root-to-leaf path in order.

    ``messages`` has conv, msg, parent, role, text, score.
    """
    levels = jumps(messages)
    answered = messages.select(F.col("conv").alias("_c"), F.col("parent").alias("_p"))
    leaves = levels[-1].filter("up IS NULL").join(answered, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("msg") == F.col("_p")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("length")), "msg"))
    leaves = leaves.select("conv", "msg", F.col("length").alias("depth"), rank.alias("branch"))
    paths = leaves if top is None else leaves.filter(F.col("branch") <= top)
    for k, level in enumerate(levels[:-1]):
        up = level.select(F.col("conv").alias("_c"), F.col("msg").alias("_m"), "up")
        both = paths.join(up, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("msg") == F.col("_m")), "left")
        steps = F.array(F.struct("msg", "depth"), F.struct(F.col("up").alias("msg"), (F.col("depth") - (1 << k)).alias("depth")))
        paths = both.select("conv", "branch", F.explode(steps).alias("at")).select("conv", "branch", "at.*").filter("msg IS NOT NULL")
    texts = messages.select(F.col("conv").alias("_c"), F.col("msg").alias("_m"), "role", "text")
    turns = paths.join(texts, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("msg") == F.col("_m")))
    return turns.groupBy("conv", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))


def format_branches(chosen: DataFrame) -> DataFrame:
    """conv, branch, formatted and loss_mask (stretches of code points, end exclusive)."""
    schema = chosen.select("conv", "branch").schema.add("formatted", "string").add("loss_mask", MASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [formatted([(t["role"] or "", t["text"] or "") for t in turns]) for turns in batch.column("turns").to_pylist()]
            masks = pa.array([[{"start": a, "end": b} for a, b in mask] for _, mask in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("branch"), pa.array([text for text, _ in done], pa.string()), masks], names=schema.names)

    return chosen.mapInArrow(run, schema)


def digest(conversations: DataFrame) -> DataFrame:
    """Counts and hashes read back from the formatted text and its mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, mask in zip(*(batch.column(k).to_pylist() for k in ("conv", "formatted", "loss_mask")), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{role}\n{body}\n" for role, body in turns), loss)]
                out.append((conv, len(turns), sha[0], len(loss), sha[1], len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=[x.split(" ")[0] for x in schema.split(", ")])

    return conversations.select(F.col("conv").cast("long").alias("conv"), "formatted", "loss_mask").mapInArrow(run, schema)
