"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttide.llm.common import running_sums, slices, stored

# Racks of a region and shards of a rack, unless a tree is given.
RACKS, PER_RACK = 2, 2


def tree(shards: int) -> dict[str, dict[str, dict[int, float]]]:
    """region -> rack -> shard -> weight, filled region by region.

    A new shard that starts a new region draws rows from every other region and moves none
    between them: regions compete with the weights they had.
    """
    out: dict[str, dict[str, dict[int, float]]] = {}
    for i in range(shards):
        region = out.setdefault(f"region{i // (RACKS * PER_RACK)}", {})
        rack = region.setdefault(f"rack{i // PER_RACK % RACKS}", {})
        rack[i] = 1.0
    return out


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, path: str, weight: float) -> Column:
    """An exponential draw with rate ``weight``, from the key and the node's own path alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 12) + F.lit(0.5)) / F.lit(2.0**52)
    return -F.log(uniform) / F.lit(weight)


def _least(key: Column, path: str, children: dict) -> Column:
    """Index of the child with the least draw, in the order of ``children``."""
    alive = [(i, name) for i, name in enumerate(children) if _weight(children[name]) > 0]
    draws = [
        F.struct(_draw(key, f"{path}/{name}", _weight(children[name])).alias("d"), F.lit(i).alias("i"))
        for i, name in alive
    ]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["i"]


def shard_column(key: Column, nodes: dict, path: str = "") -> Column:
    """The shard of a key: at each level the child with the least weighted draw.

    A draw depends on the key, the child's path and its weight only. When weights change below
    one child, its siblings' draws stay: rows move into it or out of it, never between siblings.
    """
    chosen = _least(key, path, nodes)
    out = F.lit(None).cast("int")
    for i, (name, child) in enumerate(nodes.items()):
        leaf = shard_column(key, child, f"{path}/{name}") if isinstance(child, dict) else F.lit(name)
        out = leaf.cast("int") if len(nodes) == 1 else F.when(chosen == i, leaf).otherwise(out)
    return out


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and place of every document, by the law of keys: doc_id and the tree decide.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. ``size`` is the text's UTF-8
    bytes plus 1, null text counts as none and has the checksum of no bytes. Rows that repeat an
    id share a shard and have slots of their own; a null id is a key like any other. Slots follow
    the id's hash, then id, size and checksum, so reruns agree up to equal rows. Regions have to be
    full, or a new shard would draw rows to its neighbours too: other numbers of shards are an error.
    """
    if shards < 1 or shards % (RACKS * PER_RACK):
        raise ValueError(f"the number of shards has to be a multiple of {RACKS * PER_RACK}")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    size, checksum = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    rows = stored(
        docs.select(
            "doc_id",
            size.alias("size"),
            checksum.alias("text_crc32"),
            shard_column(key, tree(shards)).alias("shard"),
            shard_column(key, tree(shards + 1)).alias("grown_shard"),
            F.xxhash64(key, size, checksum).alias("__key"),
        ),
        "shards",
    )
    n = slices((rows.count() + shards - 1) // shards)
    placed = running_sums(
        rows, ["shard"], "__key", ["doc_id", "size", "text_crc32"], {"slot": F.lit(1).cast("long")}, n
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
