"""Scalar functions over columns: response codes, record types, addresses, names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import dims


def _map(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(entries.items())))


def rcode_text(code: Column, context: Column | None = None) -> Column:
    """Text of a response code; context `EdnsOpt` prints 16 as EDNS_BADVERS and other extended codes by number."""
    plain = F.coalesce(F.try_element_at(_map(dims.RESPONSE_CODES), code.cast("int")), code.cast("string"))
    if context is None:
        return plain
    return F.when((context == "EdnsOpt") & (code == 16), F.lit(dims.EDNS_BADVERS)).otherwise(plain)


def rcode_parse(text: Column) -> Column:
    """Number of a response code's name or decimal text; null if it is neither."""
    plain = F.translate(F.lower(text), " -_", "")
    number = F.when(plain.rlike("^[0-9]{1,5}$"), plain.cast("int"))
    return F.coalesce(F.try_element_at(_map(dims.CODE_ALIASES), plain), F.when(number <= 65535, number))


def qtype_text(qtype: Column) -> Column:
    return F.when(qtype.isNotNull(), F.coalesce(F.try_element_at(_map(dims.RECORD_TYPES), qtype.cast("int")), F.lit(dims.UNKNOWN_TYPE)))


def u8(data: Column, at: Column | int) -> Column:
    """The byte at a zero-based offset, null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def u16(data: Column, at: Column | int) -> Column:
    """The big-endian 16-bit number at a zero-based offset, null if it isn't whole."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(2))
    return F.when(F.octet_length(part) == 2, F.conv(F.hex(part), 16, 10).cast("int"))


def ip_text_v4(ip: Column) -> Column:
    return F.concat_ws(".", *(u8(ip, k).cast("string") for k in range(4)))


def ip_text_v6(ip: Column) -> Column:
    """The address with its longest run of at least two zero groups (the first of equals) as `::`; mapped IPv4
    addresses end in dotted form."""
    groups = F.transform(F.array(*(F.hex(F.substring(ip, 2 * k + 1, 2)) for k in range(8))), lambda g: F.lower(F.regexp_replace(g, "^0{1,3}", "")))
    whole = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    out = None
    for n in range(8, 1, -1):
        run = ":" + "0:" * n
        short = F.concat(F.substring_index(whole, run, 1), F.lit("::"), F.substr(whole, F.instr(whole, run) + len(run)))
        case = F.instr(whole, run) > 0
        out = F.when(case, short) if out is None else out.when(case, short)
    text = out.otherwise(whole)
    # drop the outer colons that only marked the ends
    text = F.regexp_replace(F.regexp_replace(text, "^:(?!:)", ""), "(?<!:):$", "")
    mapped = F.hex(F.substring(ip, 1, 12)) == "00000000000000000000FFFF"
    return F.when(mapped, F.concat(F.lit("::ffff:"), ip_text_v4(F.substring(ip, 13, 4)))).otherwise(text)


def ip_text(ip: Column) -> Column:
    return F.when(F.octet_length(ip) == 4, ip_text_v4(ip)).when(F.octet_length(ip) == 16, ip_text_v6(ip))


def normalized_name(name: Column) -> Column:
    """Trimmed, A-Z in lower case."""
    return F.translate(F.trim(name), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_root(name: Column) -> Column:
    return name == "."


def is_reverse(name: Column) -> Column:
    low = F.lower(name)
    return F.endswith(low, F.lit(".in-addr.arpa")) | F.endswith(low, F.lit(".ip6.arpa"))


def has_odd_label(name: Column, least: int = 12, digits: int = 6, hexes: int = 10) -> Column:
    """Whether a label of `least` characters has so many digits, or so many hexadecimal characters."""
    return F.exists(F.split(name, "\\."), lambda s: (F.char_length(s) >= least) & ((F.regexp_count(s, F.lit("[0-9]")) >= digits) | (F.regexp_count(s, F.lit("[0-9A-Fa-f]")) >= hexes)))


def suffixes(name: Column) -> Column:
    """A name and every part of it behind a dot."""
    labels = F.split(F.lower(name), "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def present_label(label: Column) -> Column:
    """A label's bytes (a string of ASCII characters) as text: letters, digits and _ as they are, - unless first, * if first;
    other printable characters behind a backslash; others are not ASCII text and belong to the decoder."""
    head = F.regexp_replace(F.substring(label, 1, 1), r"([^0-9A-Za-z_*])", r"\\$1")
    rest = F.regexp_replace(F.substr(label, F.lit(2)), r"([^0-9A-Za-z_-])", r"\\$1")
    return F.concat(head, rest)


def wire_name(name: Column) -> Column:
    """Wire form of a plain name: length-prefixed labels and a zero byte; one trailing dot is ignored, the root is a
    zero byte; a name with an empty or an over-long label is null."""
    bare = F.when(name == ".", F.lit("")).otherwise(F.regexp_replace(name, "\\.$", ""))
    labels = F.split(bare, "\\.")
    good = F.forall(labels, lambda s: (F.octet_length(s) > 0) & (F.octet_length(s) <= 63))
    joined = F.array_join(F.transform(labels, lambda s: F.concat(F.lpad(F.hex(F.octet_length(s)), 2, "0"), F.hex(F.encode(s, "UTF-8")))), "")
    return F.when(bare == "", F.unhex(F.lit("00"))).when(good, F.unhex(F.concat(joined, F.lit("00"))))


def _sql_map(entries: dict) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "map(" + ", ".join(quote(x) for x in chain.from_iterable(entries.items())) + ")"


def register(spark: SparkSession) -> None:
    """rcode_text, rcode_parse, qtype_text, normalized_name and is_reverse_name as SQL functions (expressions, not UDFs)."""
    plain = "translate(lower(x), ' -_', '')"
    number = f"CASE WHEN {plain} RLIKE '^[0-9]{{1,5}}$' AND CAST({plain} AS INT) <= 65535 THEN CAST({plain} AS INT) END"
    for name, kind, out, body in (
        ("rcode_text", "INT", "STRING", f"coalesce(try_element_at({_sql_map(dims.RESPONSE_CODES)}, x), CAST(x AS STRING))"),
        ("rcode_parse", "STRING", "INT", f"coalesce(try_element_at({_sql_map(dims.CODE_ALIASES)}, {plain}), {number})"),
        ("qtype_text", "INT", "STRING", f"CASE WHEN x IS NOT NULL THEN coalesce(try_element_at({_sql_map(dims.RECORD_TYPES)}, x), '{dims.UNKNOWN_TYPE}') END"),
        ("normalized_name", "STRING", "STRING", "translate(trim(x), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
        ("is_reverse_name", "STRING", "BOOLEAN", "endswith(lower(x), '.in-addr.arpa') OR endswith(lower(x), '.ip6.arpa')"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x {kind}) RETURNS {out} RETURN {body}")
