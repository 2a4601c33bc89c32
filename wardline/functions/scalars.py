"""Scalar functions as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import dims


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970; timestamps without a zone are taken in the session's, which is UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def connection_key(proto, local, lport, remote, rport, pid) -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c for c in (proto, local, lport, remote, rport, pid)))


def level_name(level: Column) -> Column:
    out = F.lit("info")
    for k, name in dims.LEVELS.items():
        out = F.when(level == k, name).otherwise(out)
    return out


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[\r\n\t ]+", " "), "^ | $", "")


def truncated(text: Column, size: int) -> Column:
    """At most ``size`` bytes, cut between characters, with an ellipsis where something was cut."""
    raw = text.cast("binary")
    # A byte 10xxxxxx behind the cut continues a character, which then goes as a whole; it has three such bytes at most.
    inside = lambda k: (F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("int").bitwiseAND(0xC0) == 0x80) if k >= 1 else F.lit(False)
    end = F.lit(max(0, size - 3))
    for back in (2, 1, 0):
        ends = F.lit(max(0, size - back))
        end = F.when(~inside(size - back + 1), ends).otherwise(end)
    cut = F.substring(raw, F.lit(1), end).cast("string")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(cut, F.lit("…")))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def first_field(data: Column, *keys: str) -> Column:
    """The first value that is neither empty nor `-`."""
    return F.coalesce(*(F.nullif(F.nullif(F.trim(F.try_element_at(data, F.lit(k))), F.lit("")), F.lit("-")) for k in keys))


def account(user: Column, domain: Column) -> Column:
    """domain\\user; a missing user is `(empty)`, a missing domain goes with its backslash."""
    name = F.coalesce(F.nullif(user, F.lit("")), F.lit("(empty)"))
    return F.when(F.coalesce(domain, F.lit("")) == "", name).otherwise(F.concat(domain, F.lit("\\"), name))


def stop_code(text: Column) -> Column:
    """The number of a stop code, hexadecimal with 0x or decimal, cut at a blank, parenthesis or comma; null if it is none or zero."""
    word = F.regexp_extract(F.trim(text), r"^([^ (,]*)", 1)
    number = F.when(word.rlike("(?i)^0x[0-9a-f]{1,16}$"), F.conv(F.substring(word, 3, 16), 16, 10)).when(word.rlike("^[0-9]{1,19}$"), word)
    value = number.try_cast("long")
    return F.when(value != 0, value)


def stop_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for k, v in dims.STOP_CODES.items() for x in (k, v)))
    text = F.lower(F.hex(code))
    hexed = F.concat(F.lit("0x"), F.upper(F.when(F.length(text) < 8, F.lpad(text, 8, "0")).otherwise(text)))
    return F.concat_ws(" ", hexed, F.try_element_at(names, code))


def rounded1(v: Column) -> Column:
    return F.floor(v * 10 + 0.5) / 10


def cpu_percent(idle: Column, kernel: Column, user: Column) -> Column:
    """From deltas; kernel time includes idle time."""
    total = kernel + user
    return F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (total - idle) / total)))


def utilisation(rate_in: Column, rate_out: Column, speed: Column) -> Column:
    return F.when(speed > 0, F.least(F.lit(100.0), F.greatest(rate_in, rate_out) * 8 * 100 / speed)).otherwise(0.0)


def violates(value: Column, op: Column, threshold: Column) -> Column:
    return F.when(op == ">", value > threshold).when(op == ">=", value >= threshold).when(op == "<", value < threshold).when(op == "<=", value <= threshold).otherwise(False)


def cleared(value: Column, op: Column, threshold: Column, hysteresis: Column) -> Column:
    return F.when(op.isin(">", ">="), value < threshold - hysteresis).otherwise(value > threshold + hysteresis)


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Colons, groups of one to four hexadecimal digits, one double colon at most, and maybe an IPv4 tail.
V6 = rf"(?i)^(?=[^.]*:)(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:$)(?=(?:[^:]*:){{2,8}}[^:]*$)(?:[0-9a-f]{{0,4}}:){{2,7}}(?:[0-9a-f]{{0,4}}|{OCTET}(?:\\.{OCTET}){{3}})$".replace("\\\\", "\\")


def valid_ip(ip: Column) -> Column:
    """Whether the text is an IPv4 address, or an IPv6 address with eight groups or a double colon."""
    four = ip.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$")
    groups = F.size(F.split(ip, ":")) + F.when(ip.contains("."), 1).otherwise(0)
    return F.coalesce(four | (ip.rlike(V6) & ((groups == 8) | (ip.contains("::") & (groups <= 9)))), F.lit(False))


def ignored_ip(ip: Column, own: list[str] | None = None) -> Column:
    """Not an address, or loopback, unspecified, multicast, broadcast, or one of ``own``."""
    special = ip.rlike(r"(?i)^(127\.|22[4-9]\.|23\d\.|0\.0\.0\.0$|255\.255\.255\.255$|(0{1,4}:){7}0{0,3}[01]$|::1?$|ff[0-9a-f]{2}:)")
    return F.coalesce(~valid_ip(ip) | special | ip.isin(own or []), F.lit(True))


def looks_outbound(lport: Column, rport: Column) -> Column:
    return (rport != 0) & (lport >= dims.EPHEMERAL_START) & ((rport < 1024) | rport.isin(dims.SERVICE_PORTS))


def ip_number(ip: Column) -> Column:
    """A sort key for IPv4 addresses."""
    part = F.split(ip, r"\.")
    return sum((F.get(part, F.lit(k)).try_cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0))


def ip_key(ip: Column) -> Column:
    """A sort key of any address, as 32 hexadecimal digits; IPv4 addresses, also inside IPv6 ones, come by their number. Null for other texts."""
    plain = F.regexp_replace(F.lower(ip), "^::ffff:(?=[0-9]+[.])", "")
    four = F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.hex(ip_number(plain)), 8, "0"))
    halves = F.split(plain, "::", 2)
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    six = F.array_join(F.transform(F.concat(left, missing, right), lambda g: F.lpad(g, 4, "0")), "")
    return F.when(valid_ip(plain), F.lower(F.when(plain.contains(":"), six).otherwise(four)))


def mac_digits(mac: Column) -> Column:
    bare = F.upper(F.regexp_replace(F.trim(mac), "[:.\\- ]", ""))
    return F.when(bare.rlike("^[0-9A-F]{12}$"), bare)


def short_name(name: Column) -> Column:
    cut = lambda text, suffix: F.when(F.instr(text, suffix) > 3, F.substring(text, F.lit(1), F.instr(text, suffix) - 1)).otherwise(text)
    return F.trim(F.aggregate(F.array(*map(F.lit, dims.LEGAL_SUFFIXES)), name, cut))


def normalised(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[ \-_.(),]", "")


def iso_date(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{8}$"), F.regexp_replace(text, "^(....)(..)(..)$", "$1-$2-$3")).otherwise(text)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def csv_safe(text: Column) -> Column:
    return F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def _segments(text: Column) -> Column:
    """Between dots, dashes, plus signs and blanks, without empty ones; a leading v, then a leading `< `, goes."""
    bare = F.regexp_replace(F.regexp_replace(text, "^v", ""), "^< ", "")
    return F.filter(F.split(bare, "[.\\-+ ]"), lambda x: x != "")


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1: segments of digits compared as numbers, others as text; a missing one is 0 to a number and empty to a text."""
    # Numbers of any length compare by length and text once their zeros in front are gone.
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")

    def one(p, q):
        p, q = F.coalesce(p, F.lit("")), F.coalesce(q, F.lit(""))
        x, y = F.when(p == "", "0").otherwise(p), F.when(q == "", "0").otherwise(q)
        number = (p.rlike("^[0-9]+$") | (p == "")) & (q.rlike("^[0-9]+$") | (q == ""))
        m, n = bare(x), bare(y)
        by_size = F.when(F.length(m) != F.length(n), F.signum(F.length(m) - F.length(n)).cast("int")).when(m < n, -1).when(m > n, 1).otherwise(0)
        return F.when(number, by_size).when(p < q, -1).when(p > q, 1).otherwise(0)

    return F.aggregate(F.zip_with(_segments(a), _segments(b), one), F.lit(0), lambda s, v: F.when(s != 0, s).otherwise(v))


def later_version(installed: Column, latest: Column) -> Column:
    """Whether the first dotted number in ``latest`` is larger than that in ``installed``, by four parts."""
    found = lambda c: F.regexp_extract(c, r"\d+(\.\d+)+", 0)
    part = lambda c, k: F.coalesce(F.get(F.split(found(c), r"\."), F.lit(k)).try_cast("long"), F.lit(0))
    out = F.lit(False)
    for k in (3, 2, 1, 0):
        x, y = part(installed, k), part(latest, k)
        out = F.when(x != y, y > x).otherwise(out)
    return (found(installed) != "") & (found(latest) != "") & out


def volume_state(used: Column) -> Column:
    return F.when(used >= 97, "critical").when(used >= 92, "low").when(used >= 85, "watch").otherwise("ok")


def grade(score: Column) -> Column:
    return F.when(score < 50, "critical").when(score < 75, "degraded").when(score < 90, "good").otherwise("excellent")


def glob_regex(scope: str) -> str:
    """A regular expression for comma-separated globs, case ignored; `*` and `?` don't cross `/`. An empty scope takes everything, a blank
    alternative nothing; an alternative also takes what it is literally."""
    if not scope:
        return "(?s)^.*$"
    out = []
    for one in scope.lower().replace("\\", "/").split(","):
        text, k = "", 0
        one = one.strip()
        if not one:
            continue
        while k < len(one):
            c = one[k]
            if c == "*":
                text += "[^/]*"
            elif c == "?":
                text += "[^/]"
            elif c == "[":
                end = one.find("]", k + 2)
                if end < 0:
                    text = None  # a bad pattern fits only what it is literally
                    break
                inner = re.sub(r"([\[\]&\\])", r"\\\1", one[k + 1 : end])
                text += f"[{inner}]"
                k = end
            else:
                text += re.escape(c)
            k += 1
        out += [x for x in (text, re.escape(one)) if x is not None]
    return f"(?s)^(?:{'|'.join(dict.fromkeys(out))})$" if out else "^\\b$"


def in_scope(instance: Column, scope: str) -> Column:
    return F.translate(F.lower(instance), "\\", "/").rlike(glob_regex(scope))


def norm_hex(text: Column) -> Column:
    """Lower case, trimmed, without 0x in front."""
    return F.regexp_replace(F.lower(F.trim(text)), "^0x", "")


def or_dash(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("-"))


def short_list(items: Column, most: int) -> Column:
    """The first items, and how many more there are."""
    text = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(F.size(items) == 0, "-").when(F.size(items) > most, F.concat(text, F.lit(" +"), (F.size(items) - most).cast("string"))).otherwise(text)


def detail_text(items: Column, most: int = 8) -> Column:
    """Items joined by commas, those beyond ``most`` counted."""
    more = F.concat(F.lit("+"), (F.size(items) - most).cast("string"), F.lit(" more"))
    return F.array_join(F.when(F.size(items) > most, F.concat(F.slice(items, 1, most), F.array(more))).otherwise(items), ", ")


def known_texts(codes: Column, table: dict[str, str], other: str, none: str, joint: str) -> Column:
    """Texts of codes by a table; a code that isn't there keeps its name behind ``other``; ``none`` without codes."""
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    found = F.transform(F.filter(codes, lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(names, c), F.concat(F.lit(other + " "), c)))
    return F.when(F.size(found) == 0, none).otherwise(F.array_join(found, joint))


def reasons(codes: Column) -> Column:
    return known_texts(codes, dims.LOGON_STATUS, "status", "no reason recorded", "; ")


def logon_types(types: Column) -> Column:
    return known_texts(types, dims.LOGON_TYPES, "type", "unknown", " / ")


def status_code(data: Column) -> Column:
    """The failure code of a logon event: the sub-status if it is known, the status if that is, else the first that is there."""
    code = lambda *k: F.lower(first_field(data, *k))
    known = lambda c: F.when(c.isin(list(dims.LOGON_STATUS)), c)
    return F.coalesce(known(code("SubStatus")), known(code("Status")), code("SubStatus", "Status"), F.lit(""))


def exception_text(codes: Column) -> Column:
    """The text of the first known exception code."""
    names = F.create_map(*(F.lit(x) for pair in dims.EXCEPTION_CODES.items() for x in pair))
    return F.coalesce(F.get(F.filter(F.transform(codes, lambda c: F.try_element_at(names, c)), lambda t: t.isNotNull()), F.lit(0)), F.lit("an unknown error"))


def rounded2(v: Column) -> Column:
    return F.round(v, 2)


def bilingual(text: Column, language: str) -> Column:
    """A struct<en, ar> in a language; English where there is no other."""
    return F.coalesce(F.nullif(text["ar"], F.lit("")), text["en"]) if language == "ar" else text["en"]


def named(code: Column, table: dict, other: str) -> Column:
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), F.lit(other))


def interface_kind(kind: Column) -> Column:
    return named(kind.cast("int"), dims.INTERFACE_KINDS, "other")


def tcp_state(code: Column) -> Column:
    return named(code.cast("int"), dims.TCP_STATES, "UNKNOWN")


def product_code(text: Column) -> Column:
    return text.rlike(r"^\{[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}$")


def package_id(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._+\-]{0,127}$")


def mac_text(digits: Column) -> Column:
    """Twelve hexadecimal digits as AA-BB-CC-DD-EE-FF."""
    return F.regexp_replace(digits, "(..)(?=.)", "$1-")


def model_name(code: Column) -> Column:
    """The product of an exact machine identifier; others stay as they are."""
    names = F.create_map(*(F.lit(x) for pair in dims.MODEL_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), code)


def preferred_name(names: Column) -> Column:
    """struct<name, source> of the first source, in order of preference, that has a name in a map of names by source."""
    found = F.filter(F.array(*(F.struct(F.try_element_at(names, F.lit(s)).alias("name"), F.lit(s).alias("source")) for s in dims.NAME_SOURCES)), lambda x: x["name"] != "")
    return F.get(found, F.lit(0))


def upgrade_command(id_: Column) -> Column:
    """The command that upgrades a package without questions; null for what is no package id."""
    tail = " ".join(dims.UPGRADE_ARGUMENTS)
    return F.when(package_id(id_), F.concat(F.lit("winget upgrade --id "), id_, F.lit(" " + tail)))


def listen_key(proto: Column, port: Column) -> Column:
    return F.concat_ws(":", proto, port.cast("string"))


def maintainer(text: Column) -> Column:
    """A name before its mail address."""
    return F.trim(F.regexp_replace(text, "<.*$", ""))


def reverse_name(ip: Column) -> Column:
    """The name that an IPv4 address has for reverse lookup."""
    return F.concat(F.array_join(F.reverse(F.split(ip, r"\.")), "."), F.lit(".in-addr.arpa"))


def natural_key(text: Column) -> Column:
    """Sorts numbers inside texts by value, case ignored: runs of digits without zeros in front, their length before them."""
    bare = F.regexp_replace(F.lower(text), "(?<![0-9])0+(?=[0-9])", "")
    pieces = F.regexp_extract_all(bare, F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(p).cast("string"), 4, "0"), p)).otherwise(p)), "")


def fuzzy_score(query: str, text: Column) -> Column:
    """How well a text fits a query: high where it contains it, more at its or a word's beginning; else by its characters in order,
    neighbours counting more; 0 if one is missing."""
    q = query.lower()
    if not q:
        return F.lit(1.0)
    s = F.lower(F.coalesce(text, F.lit("")))
    at = F.instr(s, q) - 1
    start = (at == 0) | F.substring(s, at, F.lit(1)).rlike(r"[\s\-_.(]")
    direct = 1000 - at - F.length(s) * 0.01 + F.when(start, 200).otherwise(0)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("score"), F.lit(0).alias("run"), F.lit(True).alias("ok"))

    def step(a, ch):
        i = F.call_function("locate", ch, s, a["at"] + 1) - 1
        run = F.when(i == a["at"], a["run"] + 1).otherwise(0)
        found = F.struct((i + 1).alias("at"), (a["score"] + 1 + run * 2).alias("score"), run.alias("run"), (a["ok"] & (i >= 0)).alias("ok"))
        return F.when(a["ok"] & (i >= 0), found).otherwise(F.struct(a["at"].alias("at"), a["score"].alias("score"), a["run"].alias("run"), F.lit(False).alias("ok")))

    along = F.aggregate(F.array(*map(F.lit, q)), zero, step)
    return F.when(at >= 0, direct.cast("double")).when(along["ok"], along["score"]).otherwise(0.0)
