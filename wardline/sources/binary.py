"""Decoders of binary tables and packets held in a BinaryType column, by built-in functions alone. Each buffer's rows become rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import scalars as X

#: Bytes of a row, and where its fields begin (local and remote address, ports, state, process).
LAYOUTS = {
    "TCP": {"row": 24, "state": 0, "local": 4, "local_port": 8, "remote": 12, "remote_port": 16, "pid": 20},
    "TCP6": {"row": 56, "local": 0, "local_port": 20, "remote": 24, "remote_port": 44, "state": 48, "pid": 52},
    "UDP": {"row": 12, "local": 0, "local_port": 4, "pid": 8},
    "UDP6": {"row": 28, "local": 0, "local_port": 20, "pid": 24},
}
NEIGHBOR_ROW, TCP_SYN, TCP_ACK, TCP_RST = 24, 0x02, 0x10, 0x04


def _hex(data: Column, at: int, size: int) -> Column:
    return F.hex(F.substring(data, at + 1, size))


def big(data: Column, at: int, size: int) -> Column:
    """The unsigned big-endian number of ``size`` bytes at ``at``."""
    return F.conv(_hex(data, at, size), 16, 10).cast("long")


def little(data: Column, at: int) -> Column:
    """The unsigned little-endian number of four bytes at ``at``."""
    return F.conv(F.concat(*(_hex(data, at + k, 1) for k in (3, 2, 1, 0))), 16, 10).cast("long")


def ipv4_text(data: Column, at: int) -> Column:
    return F.concat_ws(".", *(F.conv(_hex(data, at + k, 1), 16, 10) for k in range(4)))


def ipv6_text(data: Column, at: int) -> Column:
    """The canonical text: no leading zeros, the first longest run of two or more zero groups as `::`, mapped IPv4 addresses dotted."""
    whole = F.concat_ws(":", *(F.lower(F.conv(_hex(data, at + 2 * k, 2), 16, 16)) for k in range(8)))
    out = whole
    for run in range(2, 9):
        zeros = rf"^(?:(.*?):)??0(?::0){{{run - 1}}}(?::(.*))?$"
        out = F.when(whole.rlike(zeros), F.regexp_replace(whole, zeros, "$1::$2")).otherwise(out)
    return F.when(_hex(data, at, 12) == "0" * 20 + "FFFF", F.concat(F.lit("::ffff:"), ipv4_text(data, at + 12))).otherwise(out)


def _rows(buffers: DataFrame, size: int) -> DataFrame:
    """``buffers`` with a row for each table row in ``buf`` (count, then rows of ``size`` bytes): its place ``row`` from 0, its bytes ``_r``, and
    ``error``. A buffer shorter than it says, or without a count, has one row, of an error alone; an empty table has none."""
    n = little(F.col("buf"), 0)
    short = F.coalesce((F.length("buf") < 4) | (4 + n * size > F.length("buf")), F.lit(True))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring(F.col("buf"), (5 + i * size).cast("int"), F.lit(size)))
    bad = F.array(F.lit(None).cast("binary"))
    parts = F.when(short, bad).when(n == 0, F.array().cast("array<binary>")).otherwise(cut)
    out = buffers.withColumn("error", F.when(short, "table buffer truncated"))
    return out.select("*", F.posexplode(parts).alias("row", "_r"))


def socket_rows(buffers: DataFrame, proto: str) -> DataFrame:
    """Sockets of the tables in ``buf``, all of ``proto`` (TCP, TCP6, UDP or UDP6). A listening one has no remote end; state is `-` for UDP."""
    at = LAYOUTS[proto]
    r = F.col("_r")
    address = ipv6_text if proto.endswith("6") else ipv4_text
    state, far, port = F.lit("-"), F.lit(None).cast("string"), F.lit(None).cast("long")
    if "state" in at:
        state, heard = X.tcp_state(little(r, at["state"])), little(r, at["state"]) == 2
        far, port = F.when(~heard, address(r, at["remote"])), F.when(~heard, big(r, at["remote_port"], 2))
    ok = lambda c: F.when(r.isNotNull(), c)
    out = {"proto": F.lit(proto), "state": ok(state), "local_addr": ok(address(r, at["local"])), "local_port": ok(big(r, at["local_port"], 2)), "remote_addr": ok(F.coalesce(far, F.lit(""))), "remote_port": ok(F.coalesce(port, F.lit(0))), "pid": ok(little(r, at["pid"]))}
    return _rows(buffers, at["row"]).withColumns(out).drop("_r", "buf")


def neighbor_rows(buffers: DataFrame) -> DataFrame:
    """Neighbours of the ARP tables in ``buf``. Invalid rows, and those whose hardware address is empty or all zeros, are skipped; at most eight
    bytes of an address count."""
    r = F.col("_r")
    size = F.least(little(r, 4), F.lit(8)).cast("int")
    digits = F.hex(F.substring(r, F.lit(9), size))
    kind = F.when(little(r, 20) == 3, "dynamic").when(little(r, 20) == 4, "static").otherwise("other")
    kept = r.isNull() | ((little(r, 20) != 2) & (size > 0) & ~digits.rlike("^0*$"))
    out = {"ip": F.when(r.isNotNull(), ipv4_text(r, 16)), "mac": X.mac_text(digits), "if_index": little(r, 0), "type": F.when(r.isNotNull(), kind)}
    return _rows(buffers, NEIGHBOR_ROW).where(kept).withColumns(out).drop("_r", "buf")


def inbound_syns(packets: DataFrame, local: Column | None = None) -> DataFrame:
    """Connection attempts among the raw IPv4 packets in ``packet``: TCP, the first fragment, SYN without ACK or RST, and sent to ``local`` if given.
    What is too short or null is none. Adds source and destination."""
    p = F.col("packet")
    header = big(p, 0, 1).bitwiseAND(15) * 4
    whole = (F.length(p) >= 20) & (F.shiftright(big(p, 0, 1), 4) == 4) & (header >= 20) & (F.length(p) >= header + 14)
    tcp = lambda at, size: F.conv(F.hex(F.substring(p, (header + at + 1).cast("int"), F.lit(size))), 16, 10).cast("long")
    flags = tcp(13, 1)
    first = (big(p, 9, 1) == 6) & (big(p, 6, 2).bitwiseAND(0x1FFF) == 0)
    attempt = (flags.bitwiseAND(TCP_SYN) != 0) & (flags.bitwiseAND(TCP_ACK | TCP_RST) == 0)
    here = F.lit(True) if local is None else F.coalesce(ipv4_text(p, 16) == local, local.isNull())
    found = packets.where(whole & first & attempt & here)
    return found.withColumns({"src": ipv4_text(p, 12), "src_port": tcp(0, 2), "dst": ipv4_text(p, 16), "dst_port": tcp(2, 2)}).drop("packet")
