"""Chat formatting at the level of tokens.

Every turn is four parts around reserved ids: <turn> role <says> text </turn>. Roles
and texts are encoded one by one, so no token spans two of them, and the reserved
ids, which lie past the vocabulary, are spliced between them. Control strings that
occur in a role or text are escaped: a backslash is doubled, and a control string
gets a backslash after its first character, so neither the text rendered from the
ids nor the ids themselves can be taken for another turn. The loss mask comes from
prefix sums of the parts' lengths.

Rows are encoded where they are; only then are a conversation's turns brought
together, in order, and cut into parts of at most PART tokens (or one turn).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is cut before byte pairs are merged (a fixed value of this vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROLS = ("<turn>", "<says>", "</turn>")
#: Tokens of a part.
PART = 1 << 16

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Codec:
    """Text to ids and back, with the reserved ids past the vocabulary."""

    def __init__(self, ranks: bytes):
        import tiktoken

        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("pagemill", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})
        self.turn, self.says, self.end = (max(own.values()) + 2 + i for i in range(3))  # one id past the vocabulary is its end of text
        self.controls = dict(zip((self.turn, self.says, self.end), CONTROLS, strict=True))

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode()

    def render(self, ids: list[int]) -> str:
        """The formatted text, control strings included."""
        out, held = [], []
        for x in ids:
            if x in self.controls:
                out += [self.decode(held), self.controls[x]]
                held = []
            else:
                held.append(x)
        return "".join([*out, self.decode(held)])


def load_tokenizer(spark: SparkSession, path: str = TOKENIZER):
    """The vocabulary's file, read on the driver and broadcast (under 1 MB)."""
    small_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def format_conversations(rows: DataFrame, tokenizer, *, learn_from: str = "assistant") -> DataFrame:
    """conv_id, part, n_turns, ids, loss: conversations as token ids with a mask of 0 and 1.

    rows(conv_id, turn, role, text), in any order; turns are ordered by turn (null
    first), then role and text, so repeated turns have a fixed order. Null texts and
    roles are empty. The mask is 1 on the text of `learn_from` turns. A null conv_id is
    a conversation. Parts of a conversation lie in order in one partition. Texts are
    encoded whole, however long. No rows give no conversations; other columns are not
    read, whatever their names.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                roles = [codec.encode(escape(x.as_py() or "")) for x in some.column("role")]
                texts = [codec.encode(escape(x.as_py() or "")) for x in some.column("text")]
                loss = [x.as_py() == learn_from for x in some.column("role")]
                yield pa.RecordBatch.from_arrays([some.column("conv_id"), some.column("turn"), some.column("role"), some.column("h"), pa.array(roles, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int32())), pa.array(loss, pa.bool_())], ["conv_id", "turn", "role", "h", "role_ids", "text_ids", "learn"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer.value)
        held: list[tuple[list[int], list[int], bool]] = []
        now, part, size, out, out_size = (), 0, 0, [], 0

        def splice() -> tuple:
            ids, lengths, learn = [], [], []
            for role, text, own in held:
                ids += [codec.turn, *role, codec.says, *text, codec.end]
                lengths += [1 + len(role) + 1, len(text), 1]
                learn += [False, own, False]
            edge = np.cumsum([0, *lengths])
            step = np.zeros(edge[-1] + 1, np.int8)
            np.add.at(step, edge[:-1][learn], 1)
            np.add.at(step, edge[1:][learn], -1)
            return now[0], part, len(held), ids, np.cumsum(step[:-1], dtype=np.int8)

        def emit() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()))
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "part", "n_turns", "ids", "loss"])

        for batch in batches:
            for conv, role, text, learn in zip(batch.column("conv_id"), batch.column("role_ids"), batch.column("text_ids"), batch.column("learn"), strict=True):
                own = (conv.as_py(),)
                role, text = role.as_py(), text.as_py()
                more = 3 + len(role) + len(text)
                if held and (own != now or size + more > PART):
                    out.append(splice())
                    out_size += size
                    part, held, size = (part + 1 if own == now else 0), [], 0
                    if out_size > 1 << 18:
                        yield emit()
                        out, out_size = [], 0
                elif own != now:
                    part = 0
                now = own
                held.append((role, text, learn.as_py()))
                size += more
        if held:
            out.append(splice())
        if out:
            yield emit()

    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    encoded = plain.mapInArrow(encode, "conv_id long, turn long, role string, h string, role_ids array<int>, text_ids array<int>, learn boolean")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h")
    return ordered.select("conv_id", "role_ids", "text_ids", "learn").mapInArrow(assemble, "conv_id long, part int, n_turns long, ids array<int>, loss array<tinyint>")


def digests(formatted: DataFrame, tokenizer) -> DataFrame:
    """Read conversations back from their ids: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    formatted: as format_conversations() gives it, parts in order in their partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        codec = Codec(tokenizer.value)
        now, out = None, []

        def flush() -> pa.RecordBatch:
            rows = [(conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted) for conv, n, turns, chars, loss, formatted in out]
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, part, ids, loss in zip(batch.column("conv_id"), batch.column("part"), batch.column("ids"), batch.column("loss"), strict=True):
                if part.as_py() == 0:
                    if len(out) >= 1024:
                        yield flush()
                        out = []
                    now = [conv.as_py(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    out.append(now)
                ids, mask = ids.values.to_numpy(), loss.values.to_numpy().astype(bool)
                now[5] += len(codec.render(ids.tolist()))
                learned = unescape(codec.decode(ids[mask].tolist()))
                now[3] += len(learned)
                now[4].update(learned.encode())
                begins, says, ends = (np.nonzero(ids == x)[0] for x in (codec.turn, codec.says, codec.end))
                for a, b, c in zip(begins, says, ends, strict=True):
                    role, text = (unescape(codec.decode(ids[i + 1 : j].tolist())) for i, j in ((a, b), (b, c)))
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
        if out:
            yield flush()

    return formatted.select("conv_id", "part", "ids", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
