"""Address expressions: flow names, IPv4 validity and address classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4_SHAPE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
NO_PORT = ("null", "0", "", "NA")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


def flow_part(name: Column, i: int) -> Column:
    """Part ``i`` of ``localip_localport_remoteip_remoteport``; 'null' when missing."""
    return F.coalesce(strip(F.get(F.split(name, "_"), F.lit(i))), F.lit("null"))


def octet(ip: Column, i: int) -> Column:
    return F.get(F.split(ip, r"\."), F.lit(i)).try_cast("int")


def is_private(ip: Column) -> Column:
    a, b = octet(ip, 0), octet(ip, 1)
    return (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))


def flow_destination(name: Column) -> Column:
    """Last address of a flow name that holds at least two addresses, else null."""
    ips = F.filter(F.split(strip(name), "_"), lambda x: x.rlike(IPV4_SHAPE))
    return F.when(F.size(ips) >= 2, F.try_element_at(ips, F.lit(-1)))


def public_destination(name: Column) -> Column:
    ip = flow_destination(name)
    return F.when(~((octet(ip, 0) == 127) | is_private(ip)), ip)


def is_ipv4(s: Column) -> Column:
    ok = s.rlike(IPV4_SHAPE)
    for i in range(4):
        ok = ok & F.coalesce(octet(s, i) <= 255, F.lit(False))
    return F.coalesce(ok, F.lit(False))


def address_class(ip: Column) -> Column:
    inside = (
        (ip == "0.0.0.0")
        | ip.startswith("10.")
        | ip.startswith("127.")
        | ip.startswith("169.254.")
        | ip.startswith("192.168.")
        | (ip.startswith("172.") & octet(ip, 1).between(16, 31))
    )
    return F.when(inside, "internal network address").otherwise("external network address")


def address_of(name: Column) -> Column:
    """The IPv4 address a node name stands for: bare, or in front of the last colon; else null."""
    host = F.regexp_extract(name, r"(?s)^(.*):[^:]*$", 1)
    return F.when(is_ipv4(name), name).when(is_ipv4(host), host)


def generalize_address(name: Column) -> Column:
    ip = address_of(name)
    return F.when(ip.isNotNull(), address_class(ip)).otherwise(name)
