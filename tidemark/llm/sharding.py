"""Sharding over fixed virtual slots.

A record's hash names one of a fixed number of slots for good. Bytes are aggregated per slot, and a versioned table maps
slots to shards so that shards hold nearly equal bytes: slots are dealt by falling size, each to the shard that is
lightest so far. Rebalancing, or adding shards, edits that table under the next version: slots stay where they are while
their shard is below the mean, and only those beyond it move. Records are never hashed anew.

The map has one row per slot, so its size is a parameter and does not grow with the data; it is the only thing broadcast.

Cases: a null text has size 1 and the checksum of an empty text; a null id is hashed with the text alone; rows equal in id
and text share a slot and are placed one after the other; an empty table gives no rows. Input columns named like an output
are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import packed, unpacked, written

SLOTS = 8192


def _dealt(order: str, light: str, slots: str) -> str:
    """SQL that deals the slots in ``order`` to the lightest shard, starting from the loads ``light``."""
    pick = "array_position(state.light, array_min(state.light))"
    return f"""
        arrays_zip({slots}, aggregate(
            {order},
            named_struct('light', {light}, 'shard', cast(array() as array<int>)),
            (state, x) -> named_struct(
                'light', transform(state.light, (v, i) -> if(i + 1 = {pick}, v + x.bytes, v)),
                'shard', concat(state.shard, array(cast({pick} - 1 as int)))),
            state -> state.shard))"""


def slot_map(loads: DataFrame, n_shards: int, old: DataFrame | None = None) -> DataFrame:
    """The next version of the map: (version, virtual_slot, shard).

    ``loads`` has one row per used slot (virtual_slot, bytes); ``old`` is the map to edit. A slot of ``old`` whose shard
    goes away, or lies beyond the mean load of ``n_shards`` counted from the shard's largest slot on, moves; all others
    stay. Slots new since ``old`` are dealt with those that move. Ties go to the lower slot.
    """
    if old is None:
        version = 1
        held = loads.select("virtual_slot", "bytes", F.lit(None).cast("int").alias("held"))
    else:
        version = (old.agg(F.max("version")).first()[0] or 0) + 1
        was = old.select("virtual_slot", F.col("shard").alias("was"))
        inside = Window.partitionBy("was").orderBy(F.desc("bytes"), "virtual_slot")
        both = loads.join(was, "virtual_slot", "left").withColumns(
            {"sum_": F.sum("bytes").over(inside), "mean_": F.sum("bytes").over(Window.partitionBy()) / n_shards}
        )
        stays = (F.col("was") < n_shards) & (F.col("sum_") <= F.col("mean_"))
        held = both.select("virtual_slot", "bytes", F.when(stays, F.col("was")).alias("held"))
    one = held.agg(
        F.collect_list(F.when(F.col("held").isNotNull(), F.struct("held", "virtual_slot", "bytes"))).alias("stay"),
        F.sort_array(
            F.collect_list(
                F.when(F.col("held").isNull(), F.struct((-F.col("bytes")).alias("order_"), "virtual_slot", "bytes"))
            )
        ).alias("go"),
    )
    light = f"""transform(sequence(0, {n_shards - 1}), s ->
        aggregate(filter(stay, x -> x.held = s), 0L, (a, x) -> a + x.bytes))"""
    every = f"""concat(
        transform(stay, x -> named_struct('virtual_slot', x.virtual_slot, 'shard', x.held)),
        transform({_dealt("go", light, "go.virtual_slot")},
            x -> named_struct('virtual_slot', x.virtual_slot, 'shard', x['1'])))"""
    return one.select(F.explode(F.expr(every)).alias("s")).select(F.lit(version).alias("version"), "s.virtual_slot", "s.shard")


def slot_loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def shard(
    docs: DataFrame,
    n_shards: int = 8,
    slots: int = SLOTS,
    old: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Every row with its shard and its place there, and the stored map that says so.

    The rows gain ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``virtual_slot``, ``shard``, ``slot`` (the place in the
    shard, from 0 without gaps) and ``map_version``. Places follow the order of virtual slots, then id, so they come from
    the rows counted per slot and an order inside a slot; no task holds a shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        packed(docs, carry),
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(slots)).cast("int"))
    rows = written(sized, "shard-rows")
    loads = slot_loads(rows)
    edited = written(slot_map(loads, n_shards, old), "slot-map")
    along = Window.partitionBy("shard").orderBy("virtual_slot")
    first = loads.join(edited, "virtual_slot").select(
        "virtual_slot", "shard", F.col("version").alias("map_version"), (F.sum("rows").over(along) - F.col("rows")).alias("first")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32")
    nth = rows.withColumn("nth", F.row_number().over(inside) - 1)
    placed = nth.join(F.broadcast(first), "virtual_slot").withColumn("slot", (F.col("first") + F.col("nth")).cast("long"))
    return unpacked(placed, "size", "text_crc32", "virtual_slot", "shard", "slot", "map_version"), edited
