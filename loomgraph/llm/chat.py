"""Operator 4: chat formatting at the level of tokens.

Role and text of each turn are encoded separately by a lossless byte-level vocabulary, and three
reserved ids beyond the vocabulary are spliced around them, so no text can produce a control id.
Besides, ``<|`` inside texts is escaped (a backslash goes in between; existing ones are doubled up
by one), so the rendered text is unambiguous too. The loss mask is the prefix sum of +1 at the first
token of each assistant text and -1 behind its last.

Turns are range-partitioned by (conversation, turn), so one huge conversation spreads over many
tasks; each task streams its turns into blocks of whole turns. Blocks are decoded where they lie;
those of a conversation that may continue in another block give their texts, compressed, to one task,
which streams them in order, since a digest has to be sequential.

Defined results: a null text or role is empty; a null turn comes first; ties go by role, then text;
a null conv_id is a conversation of its own; repeated rows are turns of their own; an empty table
gives the added conversation only; other columns are ignored; a very long text has the ids that
the vocabulary gives it, also where it holds very long runs of blanks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .token_output import vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Reserved ids and how they are rendered.
START, BODY, END = 50257, 50258, 50259
RENDERED = {START: "<|im_start|>", BODY: "\n", END: "<|im_end|>\n"}
#: The library's pattern can't take runs of hundreds of thousands of blanks: runs from this length on are encoded as the piece that they are.
LONG_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")
#: A block ends with the turn that brings it to so many tokens.
BLOCK_TOKENS = 32_768
BLOCKS = "conv_id long, part int, block long, whole boolean, chars long, ids array<int>, mask array<byte>"
SAID = "conv_id long, part int, block long, n long, loss_chars long, chars long, said binary, loss binary"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_loaded: dict[str, object] = {}


def codec(path: str):
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def encoded(text: str, enc) -> list[int]:
    text, ids, at = escaped(text), [], 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))  # the last blank belongs to what follows
        ids += enc.encode_ordinary(text[at:run.start()]) + enc._encode_single_piece(text[run.start():end])
        at = end
    return ids + enc.encode_ordinary(text[at:])


def decoded(ids: np.ndarray, enc) -> str:
    return unescaped(enc.decode_bytes(ids.tolist()).decode())


def assembled(turns: list[tuple[str, str]], enc, trained: str) -> tuple[list[int], np.ndarray]:
    """Token ids and loss mask of the turns."""
    ids: list[int] = []
    edges: list[tuple[int, int]] = []
    for role, text in turns:
        ids += [START, *encoded(role, enc), BODY]
        first = len(ids)
        ids += encoded(text, enc)
        if role == trained:
            edges.append((first, len(ids)))
        ids.append(END)
    steps = np.zeros(len(ids) + 1, dtype=np.int8)
    for first, last in edges:
        steps[first] += 1
        steps[last] -= 1
    return ids, np.cumsum(steps[:-1], dtype=np.int8)


def blocks(path: str, trained: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = codec(path), TaskContext.get().partitionId()
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("whole", pa.bool_()), ("chars", pa.int64()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8()))])
        state = {"conv": None, "begun": False, "number": 0, "first": True, "single": True, "ids": [], "mask": [], "chars": 0}
        out: list[dict] = []

        def close(ends: bool, last: bool) -> None:
            whole = ends and state["single"] and not state["first"] and not last
            out.append({"conv_id": state["conv"], "part": part, "block": state["number"], "whole": whole, "chars": state["chars"], "ids": np.array(state["ids"], np.int32), "mask": np.concatenate(state["mask"]) if state["mask"] else np.zeros(0, np.int8)})
            state.update(number=state["number"] + 1, ids=[], mask=[], chars=0, single=False)
            if ends:
                state.update(first=False, single=True)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state["begun"] and conv != state["conv"]:
                    close(ends=True, last=False)
                elif state["begun"] and len(state["ids"]) >= BLOCK_TOKENS:
                    close(ends=False, last=False)
                ids, mask = assembled([(role or "", text or "")], enc, trained)
                state.update(conv=conv, begun=True, chars=state["chars"] + len(escaped(role or "")) + len(escaped(text or "")) + sum(map(len, RENDERED.values())))
                state["ids"].extend(ids)
                state["mask"].append(mask)
            if sum(len(x["ids"]) for x in out) >= 8 * BLOCK_TOKENS:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if state["begun"]:
            close(ends=True, last=True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def write_chat(turns: DataFrame, path: str, vocabulary: str | None = None, trained: str = "assistant") -> None:
    """Formats turns (conv_id, turn, role, text) and writes blocks of token ids with masks as Parquet."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    keys = ["conv_id", "turn", "role", "text"]
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*keys)
    ordered.select("conv_id", "role", "text").mapInArrow(blocks(vocabulary or vocabulary_path(VOCABULARY), trained), BLOCKS).write.parquet(path)


def parsed(ids: np.ndarray, enc) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, from ids alone."""
    starts, bodies, ends = (np.flatnonzero(ids == x) for x in (START, BODY, END))
    for a, b, c in zip(starts, bodies, ends):
        yield decoded(ids[a + 1:b], enc), decoded(ids[b + 1:c], enc)


def contents(ids: np.ndarray, mask: np.ndarray, enc) -> tuple[int, str, str, int]:
    """Of a block: its turns, what they say, what the loss mask covers, and its rendered characters."""
    turns = list(parsed(ids, enc))
    steps = np.diff(np.concatenate([[0], mask, [0]]))
    loss = "".join(decoded(ids[a:b], enc) for a, b in zip(np.flatnonzero(steps > 0), np.flatnonzero(steps < 0)))
    chars = len(enc.decode_bytes(ids[ids < START].tolist()).decode()) + sum(int((ids == k).sum()) * len(v) for k, v in RENDERED.items())
    return len(turns), "".join(f"{role}\n{text}\n" for role, text in turns), loss, chars


def arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        yield tuple(np.asarray(batch.column(c)[i].values) for c in ("ids", "mask"))


def sha256(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def whole_digests(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digests of conversations that lie in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path)
        for batch in batches:
            found = [contents(ids, mask, enc) for ids, mask in arrays(batch)]
            n, said, loss, chars = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(map(sha256, said), pa.string()), pa.array(map(len, loss), pa.int64()), pa.array(map(sha256, loss), pa.string()), pa.array(chars, pa.int64())], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return run


def said_in_blocks(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, pack = codec(path), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                n, said, loss, chars = contents(*next(arrays(row)), enc)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("conv_id", "part", "block")), *(pa.array([x], pa.int64()) for x in (n, len(loss), chars)), *(pa.array([pack.compress(x.encode())]) for x in (said, loss))], names=[c.split()[0] for c in SAID.split(", ")])

    return run


def joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams blocks' texts sorted by conversation; a conversation's digests are running ones."""
    import zstandard

    unpack, out, state = zstandard.ZstdDecompressor(), [], None
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def close(s) -> None:
        out.append({"conv_id": s["conv"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["loss_chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["chars"]})

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "n", "loss_chars", "chars", "said", "loss")]
        for conv, n, loss_chars, chars, said, loss in zip(*columns):
            if state is None or conv != state["conv"]:
                if state is not None:
                    close(state)
                state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            state["turns"].update(unpack.decompress(said))
            state["loss"].update(unpack.decompress(loss))
            state.update(n=state["n"] + n, loss_chars=state["loss_chars"] + loss_chars, chars=state["chars"] + chars)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    if state is not None:
        close(state)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def chat_digests(spark: SparkSession, path: str, vocabulary: str | None = None) -> DataFrame:
    vocabulary = vocabulary or vocabulary_path(VOCABULARY)
    stored = spark.read.schema(BLOCKS).parquet(path)
    whole = stored.where("whole").select("conv_id", "ids", "mask").mapInArrow(whole_digests(vocabulary), DIGESTS)
    pieces = stored.where("not whole").select("conv_id", "part", "block", "ids", "mask").mapInArrow(said_in_blocks(vocabulary), SAID)
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return whole.unionByName(pieces.mapInArrow(joined_digests, DIGESTS))


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = new_path(spark, "chat")
    write_chat(turns, path)
    return chat_digests(spark, path)
