"""Fields of link, IP, TCP and UDP headers as expressions over the frame bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: link types, protocol numbers and flag bits -----------------------------
ETHERNET = 1
RAW_IP = [12, 14, 101, 228, 229]
LOOPBACK = [0, 108]
LINUX_COOKED = 113
LINUX_COOKED_2 = 276
IPV4_TYPE = "0800"
IPV6_TYPE = "86DD"
PPP_IPV4, PPP_IPV6 = "0021", "0057"
IPV4_IN_IPV6 = 4
# From the first type field to the network header: any VLAN tags, then IP, a PPPoE session, or a
# stack of MPLS labels whose last one has the lowest bit of its third byte set.
ETHERNET_PATH = (
    "^(?:(?:8100|88A8|9100)[0-9A-F]{4})*"
    "(?:0800|86DD|8864[0-9A-F]{12}(?:0021|0057)"
    "|884[78](?:[0-9A-F]{5}[02468ACE][0-9A-F]{2})*[0-9A-F]{5}[13579BDF][0-9A-F]{2})"
)
# Bytes in which that path is looked for; only they are spelled in hex.
PATH_BYTES = 256
FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16}


def chunk(frame: Column, at: Column, size: Column | int) -> Column:
    """``size`` bytes from position ``at``, counted from 0."""
    return F.substring(frame, at + 1, size if isinstance(size, Column) else F.lit(size))


def hex_of(frame: Column, at: Column, size: int) -> Column:
    return F.hex(chunk(frame, at, size))


def number(frame: Column, at: Column, size: int) -> Column:
    """Big-endian unsigned number; NULL when the frame ends before it."""
    whole = at + size <= F.length(frame)
    return F.when(whole, F.conv(hex_of(frame, at, size), 16, 10).cast("long"))


def network_offset(frame: Column, linktype: Column) -> Column:
    """Where the network header begins, behind tags, sessions and labels; NULL for other links."""
    path = F.length(F.regexp_extract(hex_of(frame, F.lit(12), PATH_BYTES), ETHERNET_PATH, 0))
    return (
        F.when((linktype == ETHERNET) & (path > 0), F.lit(12) + (path / 2).cast("int"))
        .when(linktype.isin(RAW_IP), F.lit(0))
        .when(linktype.isin(LOOPBACK), F.lit(4))
        .when(linktype == LINUX_COOKED, F.lit(16))
        .when(linktype == LINUX_COOKED_2, F.lit(20))
    )


def network_version(frame: Column, linktype: Column, at: Column) -> Column:
    """4 or 6: the type the link header gives, confirmed by the header itself; else NULL."""
    type_at = F.when(linktype == LINUX_COOKED_2, F.lit(0)).otherwise(at - 2)
    named = linktype.isin(ETHERNET, LINUX_COOKED, LINUX_COOKED_2)
    link_type = hex_of(frame, type_at, 2)
    version = F.shiftright(number(frame, at, 1), 4)
    four = (version == 4) & link_type.isin(IPV4_TYPE, PPP_IPV4)
    six = (version == 6) & link_type.isin(IPV6_TYPE, PPP_IPV6)
    # Labels name no type; the last one is told by its odd third byte, which no type above has.
    labels = (linktype == ETHERNET) & link_type.rlike("^.[13579BDF]") & version.isin(4, 6)
    agrees = F.when(named, four | six | labels).otherwise(version.isin(4, 6))
    return F.when(agrees, version)


def ipv4_text(address: Column) -> Column:
    places = F.sequence(F.lit(1), F.lit(4))
    part = lambda i: F.conv(F.hex(F.substring(address, i, F.lit(1))), 16, 10)
    return F.array_join(F.transform(places, part), ".")


def _shorten(groups: Column) -> Column:
    """Put ``::`` for the first longest run of two or more zero groups."""
    framed = F.concat(F.lit(":"), groups, F.lit(":"))
    runs = F.regexp_extract_all(groups, F.lit("(?:^|(?<=:))0(?::0)+(?=:|$)"), F.lit(0))
    longest = F.aggregate(
        runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best)
    )
    parts = F.transform(
        F.array(F.struct(framed.alias("text"), F.concat(F.lit(":"), longest, F.lit(":")).alias("run"))),
        lambda p: F.when(
            F.length(p["run"]) > 2,
            F.concat(
                F.substring(p["text"], F.lit(2), F.greatest(F.position(p["run"], p["text"]) - 2, F.lit(0))),
                F.lit("::"),
                F.rtrim(
                    F.substring(
                        p["text"], F.position(p["run"], p["text"]) + F.length(p["run"]), F.length(p["text"])
                    ),
                    F.lit(":"),
                ),
            ),
        ),
    )
    return F.coalesce(parts[0], groups)


def ipv6_text(address: Column) -> Column:
    """Canonical form: lowercase groups, the first longest run of zero groups as ``::``.

    Addresses that embed an IPv4 address end in its dotted form.
    """

    def text(digits: Column) -> Column:
        groups = F.regexp_replace(F.regexp_replace(digits, "(.{4})(?=.)", "$1:"), "(?<=^|:)0{1,3}", "")
        dotted = ipv4_text(F.substring(address, F.lit(13), F.lit(4)))
        return (
            F.when(digits.rlike("^0{20}ffff"), F.concat(F.lit("::ffff:"), dotted))
            .when(digits.rlike("^0{24}(?!0{4})"), F.concat(F.lit("::"), dotted))
            .otherwise(F.transform(F.array(groups), _shorten)[0])
        )

    # The one-element array gives the hex digits a name, so that they are computed once.
    return F.transform(F.array(F.lower(F.hex(address))), text)[0]
