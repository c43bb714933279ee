"""Chat formatting as a prefix tree: conversations that share initial turns share nodes, each emitted once in depth-first order with
position ids and the intervals of the token stream that it may attend to."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tables

END = "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: str, more: str = "") -> str:
    """Backslash, the characters that control strings begin with, and those of `more` get a backslash; unescaped() undoes it."""
    return re.sub(r"[\\#<" + re.escape(more) + "]", r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int]:
    """A turn in the template, and where its content starts."""
    head = f"### {escaped(role, ':')}: "
    return head + escaped(text) + END, len(head)


class Reader:
    """Reads formatted text piece by piece back into (role, text) turns."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.rest += piece
        out, at = [], 0
        while m := _TURN.match(self.rest, at):
            out.append((unescaped(m[1]), unescaped(m[2])))
            at = m.end()
        self.rest = self.rest[at:]
        return out


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def _packed(tokens: list[int]) -> bytes:
    """Ids as bytes: how many each has, two or four, then the ids, low bytes first."""
    ids = np.asarray(tokens, np.int64)
    kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
    return bytes([int(kind[2])]) + ids.astype(kind).tobytes()


def _unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).tolist()


def unpacked(packed: Column) -> Column:
    """The same ids as an array."""
    digits, width = F.hex(packed), F.conv(F.substring(F.hex(packed), 1, 2), 16, 10).cast("int")
    byte = lambda i, k: F.substr(digits, (3 + 2 * (i * width + k)).cast("int"), F.lit(2))
    one = lambda i: F.conv(F.when(width == 2, F.concat(byte(i, 1), byte(i, 0))).otherwise(F.concat(*(byte(i, k) for k in (3, 2, 1, 0)))), 16, 10).cast("int")
    n = ((F.octet_length(packed) - 1) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [name for name, _ in fields])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPAN = "array<struct<start:bigint,end:bigint>>"


def _next(chain: bytes, role: str, mark: bytes) -> bytes:
    """Digest of a prefix from that of the prefix before it and the turn's role and text."""
    return hashlib.blake2b(chain + len(role).to_bytes(8, "little") + role.encode() + mark, digest_size=16).digest()


def _prefixes(batches):
    """The node of every turn: sorted turns of whole conversations in, without their texts."""
    now, chain, depth = object(), b"", 0
    for batch in batches:
        rows = []
        for conv, role, mark in zip(*(batch[c].to_pylist() for c in ("conv", "role", "mark")), strict=True):
            if conv != now:
                now, chain, depth = conv, b"", 0
            chain = _next(chain, role, mark)
            rows.append((conv, depth, chain))
            depth += 1
        yield _batch(rows, [("conv", batch["conv"].type), ("depth", pa.int64()), ("node", pa.binary())])


def _branches(batches):
    """For each conversation that owns nodes: from which depth on, and the steps that lead there.

    A node's owner is the smallest conversation through it, so along a conversation owners change only from smaller ones to itself,
    and what it owns is the end of its path. Its path is told by those changes: where each owner's own turns are left and the node
    that is entered. In this order subtrees are whole and a node precedes all below it, however deep they lie.
    """
    now, before, steps, found = object(), object(), b"", False
    for batch in batches:
        rows = []
        for conv, depth, node, owner in zip(*(batch[c].to_pylist() for c in ("conv", "depth", "node", "owner")), strict=True):
            if conv != now:
                now, before, steps, found = conv, object(), b"", False
            if owner != before:
                before, steps = owner, steps + (depth.to_bytes(4, "big") + b"\0" if depth else b"") + node[:8]
            if owner == conv and not found:
                found = True
                rows.append((conv, depth, steps))
        yield _batch(rows, [("conv", batch["conv"].type), ("since", pa.int64()), ("steps", pa.binary())])


def _nodes(path: str, pattern: str):
    """The owned nodes, each encoded once: of every conversation its branch row first, then its turns."""

    def run(batches):
        encoder, now, chain, depth, since, steps = _encoder(path, pattern), object(), b"", 0, None, b""
        for batch in batches:
            rows = []
            for conv, role, mark, text, first, own in zip(*(batch[c].to_pylist() for c in ("conv", "role", "mark", "text", "since", "steps")), strict=True):
                if conv != now:
                    now, chain, depth, since = conv, b"", 0, None
                if first is not None:
                    since, steps = first, own
                    continue
                parent, chain = chain, _next(chain, role, mark)
                if since is not None and depth >= since:
                    body, at = formatted(role, text)
                    tokens = encoder.encode_ordinary(body)
                    loss = [{"start": at, "end": len(body) - len(END)}] if role == "assistant" else []
                    rows.append((chain, parent or None, conv, steps + depth.to_bytes(4, "big") + b"\1", role, _packed(tokens), len(tokens), loss))
                depth += 1
            yield _batch(rows, [("node", pa.binary()), ("parent", pa.binary()), ("owner", batch["conv"].type), ("place", pa.binary()), ("role", pa.string()), ("packed", pa.binary()), ("n_tokens", pa.int64()), ("loss", _SPANS)])

    return run


def _running(batches):
    """Adds to each row the tokens before it in its partition."""
    total = 0
    for batch in batches:
        n = batch["n_tokens"].to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total + n.cumsum() - n, pa.int64())], [*batch.schema.names, "within"])
        total += int(n.sum())


class _Trail:
    """Token intervals along one conversation, neighbours merged."""

    def __init__(self):
        self.spans: list[list[int]] = []
        self.tokens = 0

    def add(self, start: int, n: int) -> None:
        if self.spans and self.spans[-1][1] == start:
            self.spans[-1][1] += n
        else:
            self.spans.append([start, start + n])
        self.tokens += n

    def rows(self) -> list[dict]:
        return [{"start": a, "end": b} for a, b in self.spans]


def _ancestors(batches):
    """Along each conversation the place and the token intervals before a turn, given out for the turns that it owns."""
    now, trail = object(), _Trail()
    for batch in batches:
        rows = []
        for conv, node, owned, start, n in zip(*(batch[c].to_pylist() for c in ("conv", "node", "owned", "start", "n_tokens")), strict=True):
            if conv != now:
                now, trail = conv, _Trail()
            if owned:
                rows.append((node, trail.tokens, trail.rows()))
            trail.add(start, n)
        yield _batch(rows, [("of", pa.binary()), ("position", pa.int64()), ("ancestors", _SPANS)])


def chat_tree(turns: DataFrame, path: str, pattern: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of the prefix tree.

    nodes has a row for each distinct prefix of a conversation: node, parent, role, tokens (of the formatted turn; packed is the same in
    two or four bytes each), start (its place
    in the depth-first token stream), position (of its first token along its own conversation), ancestors (the stream intervals
    it attends to besides itself) and loss (spans of the decoded turn that are trained on: the content of assistant turns). paths has
    conv, node for every turn; a conversation's nodes in order of position, decoded, are its formatted form.

    Turns are ordered by turn, then role, then the text's first 32 characters and its digest. Null roles and texts are empty; null
    conv ids form one conversation. Repeated rows are turns of their own. An empty table gives empty tables. Other columns are never
    read. A first turn or a whole conversation that a third of the corpus shares is one node, encoded once: nodes are counted with
    partial sums, and joins on them can be split. Conversations of any length and depth are streamed in turn order, never held
    as one value; a node's place is told by as many steps as its conversation has owners before it, not by its depth.
    """
    of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), of(role).alias("role"), of(text).alias("text"))
    rows = rows.withColumns({"head": F.left("text", F.lit(32)), "mark": F.unhex(F.md5("text"))})
    order = ["turn", "role", "head", "mark"]
    kind = rows.schema["conv"].dataType.simpleString()
    by_conv = rows.drop("text").repartition("conv").sortWithinPartitions("conv", *order)
    paths = tables.written(by_conv.mapInArrow(_prefixes, f"conv {kind}, depth bigint, node binary"), "paths")
    owners = paths.groupBy("node").agg(F.min("conv").alias("owner")).withColumnRenamed("node", "of")
    owned = paths.join(owners, F.col("node") == F.col("of")).drop("of").repartition("conv").sortWithinPartitions("conv", "depth")
    branches = tables.written(owned.mapInArrow(_branches, f"conv {kind}, since bigint, steps binary"), "branches")

    told = branches.select("conv", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*order, "text")), "since", "steps")
    told = told.union(rows.select("conv", *order, "text", F.lit(None).cast("bigint"), F.lit(None).cast("binary"))).withColumn("later", F.col("since").isNull())
    told = told.repartition("conv").sortWithinPartitions("conv", "later", *order)
    schema = f"node binary, parent binary, owner {kind}, place binary, role string, packed binary, n_tokens bigint, loss {_SPAN}"
    loose = tables.written(told.mapInArrow(_nodes(path, pattern), schema), "nodes")
    stream = loose.repartitionByRange("place").sortWithinPartitions("place").drop("place").withColumn("part", F.spark_partition_id())
    stream = tables.written(stream.mapInArrow(_running, f"{schema.replace('place binary, ', '')}, part int, within bigint"), "stream")
    tables.dropped(branches, loose)
    bases = stream.groupBy("part").agg(F.sum("n_tokens").alias("size"))  # a row for each partition
    bases = bases.select(F.col("part").alias("p"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    nodes = stream.join(F.broadcast(bases), F.col("part") == F.col("p")).withColumn("start", F.col("base") + F.col("within"))

    along = paths.join(nodes.select(F.col("node").alias("of"), "owner", "start", "n_tokens"), F.col("node") == F.col("of"))
    along = along.select("conv", "depth", "node", F.col("conv").eqNullSafe(F.col("owner")).alias("owned"), "start", "n_tokens")
    seen = along.repartition("conv").sortWithinPartitions("conv", "depth").mapInArrow(_ancestors, f"of binary, position bigint, ancestors {_SPAN}")
    full = nodes.join(seen, F.col("node") == F.col("of")).select("node", "parent", "role", unpacked(F.col("packed")).alias("tokens"), "packed", "start", "position", "ancestors", "loss")
    return full, paths.select("conv", "node")


def read_back(nodes: DataFrame, paths: DataFrame, path: str) -> DataFrame:
    """One row for each conversation, from the tree alone: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are decoded from tokens in order of position. That each attends to exactly the tokens of the turns before it is checked on
    the way: a tree whose positions or intervals do not fit raises.
    """
    rows = paths.join(nodes.select(F.col("node").alias("of"), "packed", "start", "position", "ancestors", "loss"), F.col("node") == F.col("of"))
    rows = rows.select("conv", "packed", "start", "position", "ancestors", "loss")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        piece, state, now = {i: t for t, i in _ranks(path).items()}, None, None
        fields = [("conv", pa.null()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

        def row():
            n, turns, chars, loss, size, *_ = state
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            fields[0], out = ("conv", batch["conv"].type), []
            for conv, packed, start, position, ancestors, loss in zip(*(batch[c].to_pylist() for c in ("conv", "packed", "start", "position", "ancestors", "loss")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, Reader(), _Trail()]
                trail = state[6]
                if position != trail.tokens or ancestors != trail.rows():
                    raise ValueError(f"a turn of conversation {conv} does not attend to the turns before it")
                tokens = _unpacked(packed)
                trail.add(start, len(tokens))
                text = b"".join(map(piece.__getitem__, tokens)).decode()
                for role, content in state[5].feed(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                for span in loss:
                    trained = unescaped(text[span["start"] : span["end"]])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(text)
            yield _batch(out, fields)
        if state is not None:
            yield _batch([row()], fields)

    schema = f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.repartition("conv").sortWithinPartitions("conv", "position").mapInArrow(run, schema)
