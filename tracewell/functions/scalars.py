"""Scalar expressions of telemetry: addresses, paths, regular expressions, kernel codes. All run inside the JVM."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_regex(pattern: str, nocase: bool = False) -> str:
    """A linear-time regular expression as Java reads it: ``$`` only at the end, ``.`` all but a newline, Unicode folding.

    Back-references and look-around, which the pattern language lacks, are refused.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise ValueError("trailing backslash")
            if not in_class and pattern[i + 1] in "123456789":
                raise ValueError("back-references are not supported")
            out.append("\\\\z"[1:] if pattern[i + 1] == "z" else pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            out.append("\\[" if c == "[" and pattern[i + 1 : i + 2] != ":" else "\\&" if c == "&" else c)
            in_class = c != "]"
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "$":
            out.append("\\z")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 3
        elif re.match(r"\(\?(?:[=!]|<[=!]|>)", pattern[i:]):
            raise ValueError("look-around is not supported")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise ValueError("missing closing ]")
    return ("(?iu)" if nocase else "") + "(?d)" + "".join(out)


def glob_regex(glob: str) -> str:
    """An anchored regular expression: ``*`` and ``?`` stop at ``/``, ``**`` doesn't, classes negate by ``!`` or ``^``."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "\\":
            if i + 1 == len(glob):
                raise ValueError("trailing backslash")
            out.append(re.escape(glob[i + 1]))
            i += 2
        elif glob[i] == "[":
            negated = glob[i + 1 : i + 2] in ("!", "^")
            start = i + 1 + negated
            end = glob.find("]", start + 1)
            if end < 0:
                raise ValueError("unclosed character class")
            body = "".join("\\" + c if c in "[]&^\\" else c for c in glob[start:end])
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end + 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?=[0-9])|$)){4}$"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: without it, an expression that names a parsed part several times holds
    the parse as many times, and nested ones multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv4_number(address: Column) -> Column:
    """The address as a number; null where it isn't one in dotted form."""
    total = lambda parts: sum((parts[i].cast("long") * (1 << (8 * (3 - i))) for i in range(1, 4)), parts[0].cast("long") * (1 << 24))
    return F.when(address.rlike(_V4), let(F.split(address, r"\."), total))


def ipv6_hex(address: Column) -> Column:
    """The 32 hexadecimal digits of a version 6 address; null where it isn't one."""
    none = F.array().cast("array<string>")

    def groups(side: Column) -> Column:
        return F.when(F.length(side) == 0, none).otherwise(F.split(side, ":"))

    def plain(x: Column) -> Column:  # an IPv4 tail becomes two groups
        number = ipv4_number(F.when(F.contains(x["tail"], F.lit(".")), x["tail"]))
        two = lambda n: F.concat(F.substr(x["low"], F.lit(1), F.length(x["low"]) - F.length(x["tail"])), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
        return F.when(F.contains(x["low"], F.lit(".")), let(number, two)).otherwise(x["low"])

    def sides(halves: Column) -> Column:
        return F.struct(groups(halves[0]).alias("left"), F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(none).alias("right"), (F.size(halves) == 2).alias("cut"))

    def full(x: Column) -> Column:
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(x["left"]) - F.size(x["right"]), F.lit(0)))
        return F.when(x["cut"], F.when(F.size(x["left"]) + F.size(x["right"]) < 8, F.concat(x["left"], zeros, x["right"]))).otherwise(x["left"])

    def joined(parts: Column) -> Column:
        good = (F.size(parts) == 8) & F.forall(parts, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), ""))

    low = let(F.lower(address), lambda x: F.struct(x.alias("low"), F.regexp_extract(x, r"([0-9.]+)$", 1).alias("tail")))
    return let(let(let(F.split(let(low, plain), "::", 2), sides), full), joined)


def in_cidr(address: Column, networks: list[str]) -> Column:
    """Whether the address lies in any network; a bare address is a network of its own. Version 4 addresses mapped into
    version 6 count as version 4; what isn't an address lies in none."""
    nets = [ipaddress.ip_network(text, strict=False) for text in networks]

    def in_four(number: Column) -> Column:
        found = F.lit(False)
        for net in nets:
            if net.version == 4:
                shift = 32 - net.prefixlen
                found = found | (F.shiftright(number, shift) == (int(net.network_address) >> shift))
        return F.coalesce(found, F.lit(False))

    def in_six(six: Column) -> Column:
        found = F.lit(False)
        for net in nets:
            if net.version == 6:
                digits, bits = divmod(net.prefixlen, 4)
                want = f"{int(net.network_address):032x}"
                same = F.substr(six, F.lit(1), F.lit(digits)) == want[:digits] if digits else six.isNotNull()
                if bits:
                    own = F.conv(F.substr(six, F.lit(digits + 1), F.lit(1)), 16, 10).cast("int")
                    same = same & (F.shiftright(own, 4 - bits) == int(want[digits], 16) >> (4 - bits))
                found = found | same
        mapped = F.conv(F.substr(six, F.lit(25), F.lit(8)), 16, 10).cast("long")
        return F.coalesce(F.when(F.startswith(six, F.lit("0" * 20 + "ffff")), let(mapped, in_four)).otherwise(found), F.lit(False))

    return F.when(F.contains(address, F.lit(":")), let(ipv6_hex(address), in_six)).otherwise(let(ipv4_number(address), in_four))


def clean_path(path: Column) -> Column:
    """The lexically shortest form of a slash-separated path; an empty one is ``.``."""
    rooted = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        up = (F.size(done) > 0) & (F.coalesce(last, F.lit("")) != "..")
        return F.when(p != "..", F.concat(done, F.array(p))).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(p)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(F.size(done) == 0, F.when((p == "..") & rooted, done).otherwise(F.array(p))).otherwise(step(done, p)))
    text = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(text == "", ".").otherwise(text)


# DNS query types by number, error numbers of connects, masks of file events by priority.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 15: "MX", 16: "TXT", 28: "AAAA"}
ERRNO_RESULT = {0: "ok", 111: "refused", 110: "timeout", 101: "unreachable", 113: "unreachable", 92: "unreachable"}
FANOTIFY = ((0x8, "MODIFY"), (0x100, "CREATE"), (0x200, "DELETE"), (0xC0, "RENAME"))


def _lookup(col: Column, table: dict, other: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(other)


def dns_type(number: Column) -> Column:
    return _lookup(number, DNS_TYPES, F.concat(F.lit("TYPE"), number.cast("string")))


def connect_result(errno: Column) -> Column:
    return _lookup(errno, ERRNO_RESULT, F.lit("other"))


def connection_ms(opened_ns: Column, closed_ns: Column) -> Column:
    """Whole milliseconds; 0 if the opening is unknown or later than the close."""
    return F.when((opened_ns == 0) | (closed_ns < opened_ns), F.lit(0).cast("long")).otherwise(F.floor((closed_ns - opened_ns) / 1_000_000))


def file_operation(mask: Column) -> Column:
    out = None
    for bit, name in FANOTIFY:
        test = mask.bitwiseAND(bit) != 0
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def file_event_type(operation: Column) -> Column:
    """The event type; null, to be dropped, for an unknown operation."""
    return F.when(operation.isin("CREATE", "MODIFY", "DELETE", "RENAME"), F.concat(F.lit("FILE_"), operation))


def clamp_time(ts: Column, arrival: Column) -> Column:
    """An event without a time, or from the future, happened on arrival."""
    return F.least(F.coalesce(ts, arrival), arrival)


def start_ms(ticks: Column, boot_ms: Column, hz: int = 100) -> Column:
    return F.floor((ticks * 1000).cast("decimal(38,0)") / hz).cast("long") + boot_ms


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def image_name(comm: Column, argv0: Column, exe: Column) -> Column:
    """The kernel's 15-character name, extended by the first argument's base name; the executable's if there is none."""
    base = basename(F.coalesce(argv0, F.lit("")))
    longer = (F.length(comm) >= 15) & F.startswith(base, comm)
    return F.when(F.coalesce(comm, F.lit("")) == "", basename(F.coalesce(exe, F.lit("")))).when(longer, base).otherwise(comm)


def join_argv(raw: Column) -> Column:
    return F.array_join(F.filter(F.split(raw, "\x00"), lambda x: x != ""), " ")


def offset_text(us: Column) -> Column:
    """``+0``, ``+2.004s``, ``+1m03s``."""
    seconds = F.floor(us / 1_000_000)
    return F.when(us <= 0, "+0").when(us < 60_000_000, F.format_string("+%.3fs", us / 1_000_000)).otherwise(F.format_string("+%dm%02ds", F.floor(seconds / 60), seconds % 60))


def bytes_text(n: Column) -> Column:
    out = F.when(n < 1024, F.format_string("%d B", n))
    for k, unit in enumerate("KMGT", 1):
        scaled = F.format_string(f"%.1f {unit}iB", F.bround(n / (1024.0**k), 1))  # exact halves go to the even digit
        out = out.when(n < 1024 ** (k + 1), scaled) if unit != "T" else out.otherwise(scaled)
    return out


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, {s: i for i, s in enumerate(("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"))}, F.lit(-1))
