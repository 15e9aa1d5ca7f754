"""Training-order materialisation: sequences in a keyed random order, as fixed-stride files.

Texts are tokenized once into a stored table of sequences, each beside the task that wrote it and its place there. One
task's output is committed once, so the sequences before each task number them densely, however the table is read again:
shuffled inputs, coalesced partitions, other split sizes and lost executors give the same numbers. A keyed Feistel network
over the next even power of two, walked on until it lands below their number, sends each number to a global slot: a
permutation that needs no shuffle buffer and that anyone with the key can invert. Slots are cut into shards by range. A batch's
sequences for one shard travel as one compressed bundle; each shard is put in order in one task, which holds its
``shard_rows`` records, and written as one file of fixed-stride records, so a reader finds slot k at (k mod rows per shard) x stride and can resume anywhere.

Record: id (8 bytes), piece (4), length (4), then the token ids, ``width`` bytes each (2 or 4), padded with zeros; all
little-endian. Files
are written under a name of the attempt and renamed when whole, with equal contents in every attempt, so a task that is
run again does no harm. A writer fails unless the slots of its shard follow one another without a gap, which also guards the
numbering. The manifest lists each shard's rows, bytes and checksum.

Cases: a null or empty text is a sequence of the end id; a null id is written as the least 64-bit number and read as null;
longer texts are cut into pieces of the sequence length, none is dropped; repeated rows are sequences of their own; an
empty table gives no shards. Only the id is carried.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import small, written
from tidemark.llm.tokens import END, VOCABULARY, blocks, known_pieces
from tidemark.session import checkpoint_root

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, SHARD_ROWS, ROUNDS = 512, 65_536, 6
HEADER = np.dtype([("id", "<i8"), ("piece", "<i4"), ("length", "<i4")])
NO_ID = -(1 << 63)
#: A sequence in a bundle, before its ids; compression of bundles.
HEAD = np.dtype([("slot", "<i8"), *HEADER.descr])
LEVEL = 9


def record_type(length: int, width: int = 2) -> np.dtype:
    return np.dtype([*HEADER.descr, ("ids", f"<u{width}", (length,))])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64; fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int = ROUNDS, back: bool = False) -> np.ndarray:
    """Slots of ``numbers`` below ``n`` (or, with ``back``, the numbers of slots)."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))
    out, walking = numbers.astype(np.uint64), np.ones(len(numbers), bool)
    while walking.any():
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mixed(left + k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right + k) & mask)
        out[walking] = (left << half) | right
        walking = out >= n
    return out.astype(np.int64)


def _sequences(length: int, width: int, vocabulary: str, end: int):
    """Rows (id, text) as sequences, with the task that makes them and their places in its output."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, last = known_pieces(vocabulary), np.array([end], "<u4").tobytes()
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, row = batch["id"].fill_null(NO_ID).to_numpy(), 0
            for block in blocks(batch["text"]):
                flat = [np.frombuffer(x + last, "<u4") for x in known.of_block(block)]
                if width < 4 and any(x.max() >> 8 * width for x in flat):
                    raise ValueError(f"token ids need more than {width} bytes")
                parts = [(i, k, x[a : a + length]) for i, x in enumerate(flat) for k, a in enumerate(range(0, len(x), length))]
                own = np.fromiter((p[0] for p in parts), np.int64, len(parts)) + row
                row += len(block)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[own]),
                        pa.array(np.fromiter((p[1] for p in parts), np.int32, len(parts))),
                        pa.array(np.fromiter((len(p[2]) for p in parts), np.int32, len(parts))),
                        pa.array([p[2].astype(f"<u{width}").tobytes() for p in parts], pa.binary()),
                        pa.array(np.full(len(parts), task, np.int32)),
                        pa.array(np.arange(at, at + len(parts))),
                    ],
                    ["id", "piece", "length", "ids", "task", "place"],
                )
                at += len(parts)

    return cut


def _bundled(n: int, key: int, shard_rows: int, width: int):
    """Sequences (number, id, piece, length, ids) as bundles: those of one batch that go to one shard, compressed together."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", LEVEL)
        for batch in batches:
            slot = permuted(batch["number"].to_numpy(), n, key)
            head = np.zeros(len(slot), HEAD)
            head["slot"] = slot
            for name in ("id", "piece", "length"):
                head[name] = batch[name].to_numpy()
            order = np.argsort(slot)
            shard, ids = slot[order] // shard_rows, batch["ids"]
            cuts = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                data = head[order[a:b]].tobytes() + b"".join(ids[k].as_py() for k in order[a:b].tolist())
                out.append((int(shard[a]), b - a, len(data), codec.compress(data, asbytes=True)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "n", "size", "data"])

    return bundle


def _writer(folder: str, length: int, shard_rows: int, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(folder)
        attempt, codec, now = uuid.uuid4().hex, pa.Codec("zstd"), None
        records, held = np.zeros(0, record_type(length, width)), np.zeros(0, np.int64)
        done: list[dict] = []

        def end() -> None:
            if now is None:
                return
            rows = int(np.count_nonzero(held))
            if (held > 1).any() or not held[:rows].all():
                raise ValueError(f"shard {now}: slots with gaps or repeats")
            name, sum_, size = f"shard-{now:06d}.bin", 0, 0
            with store.open_output_stream(f"{path}/.{name}.{attempt}") as out:
                for a in range(0, rows, 4096):
                    data = records[a : min(a + 4096, rows)].tobytes()
                    out.write(data)
                    sum_, size = crc32(data, sum_), size + len(data)
            store.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")
            done.append({"shard": now, "rows": rows, "bytes": size, "crc32": sum_, "file": f"{folder}/{name}"})

        for batch in batches:
            for shard, n, size, packed in zip(*(batch[c] for c in ("shard", "n", "size", "data")), strict=True):
                if now != shard.as_py():
                    end()
                    now = shard.as_py()
                    records, held = np.zeros(shard_rows, records.dtype), np.zeros(shard_rows, np.int64)
                data = codec.decompress(packed.as_buffer(), size.as_py())
                head = np.frombuffer(data, HEAD, n.as_py())
                ids, at = np.frombuffer(data, f"<u{width}", offset=head.nbytes), 0
                place = head["slot"] - now * shard_rows
                np.add.at(held, place, 1)
                for name in ("id", "piece", "length"):
                    records[name][place] = head[name]
                for k, size in zip(place.tolist(), head["length"].tolist(), strict=True):
                    records["ids"][k, :size] = ids[at : at + size]
                    at += size
        end()
        kinds = [("shard", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("file", pa.string())]
        yield pa.RecordBatch.from_pylist(done, pa.schema(kinds))

    return write


def write_training_order(
    docs: DataFrame,
    key: int = 0,
    length: int = LENGTH,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end: int = END,
    folder: str | None = None,
    width: int = 2,
) -> DataFrame:
    """Writes the shards below ``folder`` (by default a new one in the shared folder) and returns the manifest:
    (shard, rows, bytes, crc32, file)."""
    spark = docs.sparkSession
    cut = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _sequences(length, width, vocabulary, end), "id long, piece int, length int, ids binary, task int, place long"
    )
    stored = written(cut, "sequences")
    # One row per task.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = stored.groupBy("task").agg(F.count(F.lit(1)).alias("k")).withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)))
    first = written(first, "tasks")
    tasks, n = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("k"), F.lit(0))).first()
    folder = folder or f"{checkpoint_root(spark)}/tidemark-llm/order-{uuid.uuid4().hex}"
    _make(folder)
    numbered = stored.join(small(first.select("task", "first"), tasks), "task")
    numbered = numbered.select((F.col("first") + F.col("place")).alias("number"), "id", "piece", "length", "ids")
    bundles = numbered.mapInArrow(_bundled(n, key, shard_rows, width), "shard long, n long, size long, data binary")
    shards = max(1, -(-n // shard_rows))
    sorted_ = bundles.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    manifest = sorted_.mapInArrow(_writer(folder, length, shard_rows, width), "shard long, rows long, bytes long, crc32 long, file string")
    return written(manifest, "manifest")


def _make(folder: str) -> None:
    from pyarrow.fs import FileSystem

    store, path = FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)


def read_records(
    file: str, length: int, first: int = 0, rows: int | None = None, block: int = 4096, width: int = 2
) -> Iterator[np.ndarray]:
    """Records of a shard from row ``first`` on, in blocks; a reader that stopped goes on with the row it stopped at."""
    from pyarrow.fs import FileSystem

    kind = record_type(length, width)
    store, path = FileSystem.from_uri(file)
    with store.open_input_file(path) as f:
        last = f.size() // kind.itemsize
        last = last if rows is None else min(last, first + rows)
        for a in range(first, last, block):
            f.seek(a * kind.itemsize)
            yield np.frombuffer(f.read((min(a + block, last) - a) * kind.itemsize), kind)


def read_training_order(manifest: DataFrame, length: int = LENGTH, shard_rows: int = SHARD_ROWS, width: int = 2) -> DataFrame:
    """The sequences as the files hold them: (doc_id, piece, length, slot, shard, ids_crc32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file in zip(batch["shard"].to_pylist(), batch["file"].to_pylist(), strict=True):
                slot = shard * shard_rows
                for records in read_records(file, length, width=width):
                    sums = [crc32(r[:n].astype("<u4").tobytes()) for r, n in zip(records["ids"], records["length"], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(records["id"], mask=records["id"] == NO_ID),
                            pa.array(records["piece"].astype(np.int64)),
                            pa.array(records["length"].astype(np.int64)),
                            pa.array(np.arange(slot, slot + len(records))),
                            pa.array(np.full(len(records), shard)),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "piece", "length", "slot", "shard", "ids_crc32"],
                    )
                    slot += len(records)

    spread = manifest.select("shard", "file").repartition("shard")
    return spread.mapInArrow(read, "doc_id long, piece long, length long, slot long, shard long, ids_crc32 long")
