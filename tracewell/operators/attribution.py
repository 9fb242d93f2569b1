"""Who owns a socket, and whose query a packet holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hex_endpoint(col) -> tuple:
    """(address, port) of a kernel table's little-endian hexadecimal ``AABBCCDD:PPPP``."""
    parts = [F.conv(F.substr(col, F.lit(1 + 2 * i), F.lit(2)), 16, 10) for i in (3, 2, 1, 0)]
    return F.concat_ws(".", *parts), F.conv(F.substring_index(col, ":", -1), 16, 10).cast("int")


def socket_owner(sockets: DataFrame, owners: DataFrame) -> DataFrame:
    """Sockets with the PID that holds their inode; 0 without one."""
    held = owners.groupBy(F.col("inode").alias("_inode")).agg(F.min("pid").alias("_pid"))
    return sockets.join(held, F.col("inode") == F.col("_inode"), "left").withColumn("pid", F.coalesce("_pid", F.lit(0))).drop("_inode", "_pid")


def endpoint_owner(asked: DataFrame, sockets: DataFrame, owners: DataFrame) -> DataFrame:
    """Endpoints (addr, port) with the PID that owns their socket: found among the tcp sockets first, then among the udp ones;
    null if there is none or nobody holds it. ``sockets``: protocol, addr, port, inode; ``owners``: inode, pid."""
    for protocol in ("tcp", "udp"):
        own = sockets.filter(F.col("protocol") == protocol).groupBy("addr", "port").agg(F.min("inode").alias(f"_{protocol}"))
        asked = asked.join(own, ["addr", "port"], "left")
    held = owners.groupBy(F.col("inode").alias("_inode")).agg(F.min("pid").alias("pid"))
    found = asked.withColumn("_found", F.coalesce("_tcp", "_udp"))
    return found.join(held, F.col("_found") == F.col("_inode"), "left").drop("_tcp", "_udp", "_found", "_inode")


def attribute_ports(packets: DataFrame, bound: DataFrame) -> DataFrame:
    """Packets with the owner of their port: by udp, else by tcp, else none (column via). ``bound``: protocol, port, pid."""
    for protocol in ("udp", "tcp"):
        own = bound.filter(F.col("protocol") == protocol).groupBy(F.col("port").alias(f"_{protocol}_port")).agg(F.max("pid").alias(f"_{protocol}"))
        packets = packets.join(own, F.col("port") == F.col(f"_{protocol}_port"), "left").drop(f"_{protocol}_port")
    via = F.when(F.col("_udp").isNotNull(), "udp").when(F.col("_tcp").isNotNull(), "tcp").otherwise("none")
    return packets.withColumns({"pid": F.coalesce("_udp", "_tcp"), "via": via}).drop("_udp", "_tcp")
