"""ABI entries compiled to slot layouts, and the projections that read logs and calls by them.

A layout says, for each input, where its words stand and how to show them. Static types are a fixed row of words, with the
text that comes before each; bytes, strings and arrays of static items are found by an offset word, and arrays repeat their
item's row of words. Layouts are data: they are made once for each ABI entry, joined by key, and read by one projection of
built-in functions for all entries, so logs and calls never pass through Python. What has other types (an array or tuple with
dynamic parts, more than LEAVES words to an item, types that are none) is refused: its layout keeps the entry instead.

The projections give the texts and the errors of `abi.decode_log` and `abi.decode_call`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.base import decimal_text
from . import abi

LEAVES = 64
#: Hex digits of an offset or a length that can lie within a row's data (under 256 MB).
NEAR = 7

LEAF = "struct<kind:string,bits:int,before:string>"
ARG = f"struct<param:string,stands:boolean,topic:int,form:string,head:int,head_all:int,width:int,leaves:array<{LEAF}>,after:string>"
LAYOUT = f"struct<source:string,name:string,indexed:int,words:int,words_all:int,args:array<{ARG}>,entry:string>"
READ = "struct<value:string,error:string>"


class Refused(ValueError):
    """A type that layouts do not cover."""


def _leaf(kind: str) -> tuple[str, int]:
    """(code, bits) of an elementary type."""
    if kind in ("address", "bool", "function"):
        return kind, 256
    m = re.fullmatch(r"(uint|int|bytes)(\d*)", kind)
    bits = int(m[2] or (0 if m[1] == "bytes" else 256)) * (8 if m[1] == "bytes" else 1) if m else 0
    if not 8 <= bits <= 256 or bits % 8:
        raise Refused(kind)
    return m[1], bits


def _row(kind: str, quoted: bool) -> tuple[list[dict], str]:
    """The words of a static type, each with the text before it, and the text after the last."""
    leaves: list[dict] = []

    def walk(kind: str, before: str, quoted: bool) -> str:
        array = abi._array(kind)
        if array or kind.startswith("("):
            items = [array[0]] * min(array[1], LEAVES + 1) if array else abi._split(kind[1:-1])
            before += "["
            for i, item in enumerate(items):
                before = walk(item, before + "," * (i > 0), True)
            return before + "]"
        code, bits = _leaf(kind)
        quote = '"' * quoted
        leaves.append({"kind": code, "bits": bits, "before": before + quote})
        if len(leaves) > LEAVES:
            raise Refused(kind)
        return quote

    after = walk(kind, "", quoted)
    return leaves, after


def _shape(kind: str) -> dict:
    """How a type is read: form, and for rows of words their leaves, width and the text after them."""
    if kind in ("bytes", "string"):
        return {"form": kind, "leaves": [], "after": "", "width": 1}
    array = abi._array(kind)
    listed = bool(array) and array[1] is None
    item = array[0] if listed else kind
    if abi.is_dynamic(item):
        raise Refused(kind)
    leaves, after = _row(item, listed)
    if listed and not leaves:
        raise Refused(kind)
    return {"form": "list" if listed else "static", "leaves": leaves, "after": after, "width": len(leaves)}


def layout(entry: dict, source: str, kind: str, names: Callable[[list[str]], list[str]]) -> dict:
    """The layout of an ABI entry; names gives its parameters' names."""
    inputs = entry["inputs"]
    params = names(abi.names_of(inputs))
    args, topics, head, head_all = [], 0, 0, 0
    out = {"source": source, "name": entry["name"] if kind == "event" else f"<Function {abi.signature(entry)}>"}
    try:
        for param, p in zip(params, inputs):
            what = abi.type_of(p)
            indexed = kind == "event" and bool(p.get("indexed"))
            arg = {"param": param, "stands": not indexed or abi.in_topic(what), "topic": topics if indexed else None}
            args.append(arg | _shape(what) | {"head": head, "head_all": head_all})
            size = abi._head_size(what)
            topics, head, head_all = topics + indexed, head + size * (not indexed), head_all + size
    except Refused:
        return out | {"indexed": 0, "words": 0, "words_all": 0, "args": [], "entry": json.dumps(entry)}
    return out | {"indexed": topics, "words": len(inputs) - topics, "words_all": len(inputs), "args": args, "entry": None}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _read(value: Column, error: Column) -> Column:
    return F.struct(value.alias("value"), error.alias("error"))



def _failed(error: Column) -> Column:
    return _read(F.lit(None).cast("string"), error)


def _short(n: Column | str, at: Column, body: Column) -> Column:
    return _text("ShortData: ", n, " bytes wanted at ", at, ", ", F.length(body), " are there")


def _stripped(hexed: Column) -> Column:
    return F.ltrim(hexed, F.lit("0"))


def _small(digits: Column) -> Column:
    """A number of at most NEAR hex digits."""
    return F.when(digits == "", F.lit(0)).otherwise(F.conv(digits, 16, 10).cast("int"))


def _sized(digits: Column) -> Column:
    """A number as errors show it."""
    return F.concat(F.lit("0x"), F.lower(digits))


def read_word(leaf: Column, body: Column, at: Column) -> Column:
    """The word at a byte of the body (value, error), shown as its kind is."""
    kind, bits = leaf["kind"], leaf["bits"]
    digits = F.call_function("div", bits, F.lit(4)).cast("int")
    none = F.lit(None).cast("string")

    def shown(word: Column) -> Column:
        """word: in upper-case hex."""
        own = F.right(word, digits)
        below = (kind == "int") & (own >= "8")
        pad = F.when(below, F.lit("F")).otherwise(F.lit("0"))
        number = F.when(below, F.translate(own, "0123456789ABCDEF", "FEDCBA9876543210")).otherwise(own)
        long_ = F.length(_stripped(word)) > F.when(kind == "address", 40).otherwise(digits)
        error = (
            F.when(F.length(word) < 64, _short("32", at, body))
            .when((kind == "uint") & long_, "BadPadding: bytes before a number are not zero")
            .when((kind == "address") & long_, "BadPadding: bytes before an address are not zero")
            .when((kind == "bool") & ~_stripped(word).isin("", "1"), "BadPadding: a truth value is neither 0 nor 1")
            .when((kind == "bytes") & (F.length(F.rtrim(word, F.lit("0"))) > digits), "BadPadding: bytes after the value are not zero")
            .when((kind == "int") & (F.ltrim(F.left(word, 64 - digits), pad) != ""), "BadPadding: bytes before a number do not continue its sign")
        )
        sign = F.when(below, F.lit("-")).otherwise(F.lit(""))
        plus = F.when(below, 1).otherwise(0)
        in_hex = F.when(kind == "address", F.right(word, F.lit(40))).when(kind == "bytes", F.left(word, digits)).otherwise(F.left(word, F.lit(48)))
        value = (
            F.when(kind.isin("uint", "int"), F.concat(sign, bind(_stripped(number), lambda d: decimal_text(d, plus))))
            .when(kind == "bool", F.when(_stripped(word) == "", F.lit("false")).otherwise(F.lit("true")))
            .otherwise(F.concat(F.lit("0x"), F.lower(in_hex)))
        )
        return bind(error, lambda e: _read(F.when(e.isNull(), value).otherwise(none), e))

    return bind(F.hex(F.substr(body, at + 1, F.lit(32))), shown)


def _joined(reads: Column, text: Callable[[Column], Column]) -> Column:
    """One read of many: text(values), or the first error."""
    error = F.get(F.filter(F.transform(reads, lambda r: r["error"]), lambda e: e.isNotNull()), F.lit(0))
    return bind(error, lambda e: F.when(e.isNull(), _read(text(F.transform(reads, lambda r: r["value"])), e)).otherwise(_failed(e)))


def read_row(arg: Column, body: Column, at: Column) -> Column:
    """The words of a static type from a byte of the body on."""

    def each(leaf: Column, i: Column) -> Column:
        return bind(read_word(leaf, body, at + i * 32), lambda r: _read(F.concat(leaf["before"], r["value"]), r["error"]))

    return bind(F.transform(arg["leaves"], each), lambda rs: _joined(rs, lambda vs: F.concat(F.array_join(vs, ""), arg["after"])))


def _place(arg: Column, body: Column, head: Column) -> Column:
    """(at, n, error): the byte at which an input's value begins, and its number of items or bytes; a static one is one item."""
    hexed = lambda at: F.hex(F.substr(body, at + 1, F.lit(32)))
    found = lambda at, n, error: F.struct(at, n, error).cast("struct<at:int,n:int,error:string>")
    none = F.lit(None)
    size, listed = F.length(body), arg["form"] == "list"
    unfit = lambda n: _text("ShortData: an array of ", n, " items does not fit")

    def counted(at: Column, digits: Column) -> Column:
        def near(n: Column) -> Column:
            pad = F.pmod(-n, F.lit(32))
            error = (
                F.when(listed, F.when(n.cast("long") * arg["width"] * 32 > size - at, unfit(n)))
                .when(at + n > size, _short(n, at, body))
                .when(at + n + pad > size, _short(pad, at + n, body))
                .when(_stripped(F.hex(F.substr(body, at + n + 1, pad))) != "", F.lit("BadPadding: bytes after the value are not zero"))
            )
            return found(at, n, error)

        far = F.when(listed, unfit(_sized(digits))).otherwise(_short(_sized(digits), at, body))
        return F.when(F.length(digits) > NEAR, found(none, none, far)).otherwise(bind(_small(digits), near))

    def at_word(word: Column, at: Column, then: Callable[[Column], Column]) -> Column:
        return F.when(F.length(word) < 64, found(none, none, _short("32", at, body))).otherwise(bind(_stripped(word), then))

    def at_offset(digits: Column) -> Column:
        near = bind(_small(digits), lambda at: bind(hexed(at), lambda w: at_word(w, at, lambda n: counted(at + 32, n))))
        return F.when(F.length(digits) > NEAR, found(none, none, _short("32", _sized(digits), body))).otherwise(near)

    return F.when(arg["form"] == "static", found(head, F.lit(1), none)).otherwise(bind(hexed(head), lambda w: at_word(w, head, at_offset)))


def read_input(arg: Column, body: Column, head: Column) -> Column:
    """(value, error) of an input whose first word is at head: a row of words, or what an offset word there tells the place of:
    bytes, a string or an array of rows."""
    none = F.lit(None).cast("string")

    def at_place(p: Column) -> Column:
        raw = F.substr(body, p["at"] + 1, p["n"])
        text = F.when(F.is_valid_utf8(raw.cast("string")), _read(raw.cast("string"), none)).otherwise(_failed(F.lit("EventError: bytes are no UTF-8 text")))
        numbers = F.when(p["n"] > 0, F.sequence(F.lit(0), p["n"] - 1)).otherwise(F.array().cast("array<int>"))
        rows = F.transform(numbers, lambda j: read_row(arg, body, p["at"] + j * arg["width"] * 32))
        shown = lambda vs: F.when(arg["form"] == "list", F.concat(F.lit("["), F.array_join(vs, ","), F.lit("]"))).otherwise(F.get(vs, F.lit(0)))
        return (
            F.when(p["error"].isNotNull(), _failed(p["error"]))
            .when(arg["form"] == "bytes", _read(F.concat(F.lit("0x"), F.lower(F.hex(raw))), none))
            .when(arg["form"] == "string", text)
            .otherwise(bind(rows, lambda rs: _joined(rs, shown)))
        )

    return bind(_place(arg, body, head), at_place)


def as_binary(text: Column) -> Column:
    """The bytes of hex text, with 0x or not; null if it is none."""
    digits = F.when(F.lower(F.left(text, F.lit(2))) == "0x", F.substr(text, F.lit(3))).otherwise(text)
    return F.when(F.length(digits) % 2 == 0, F.unhex(digits))


def _hexed_error(text: Column, raw: Column) -> Column:
    return F.when(text.isNull(), "EventError: no data").when(raw.isNull(), "EventError: no hex text")


def _values(args: Column, read: Callable[[Column], Column]) -> Column:
    """(values, error) of all inputs; those in the body are read before those in topics."""
    kind = "struct<values:array<string>,error:string>"

    def ended(reads: Column) -> Column:
        wrong = F.filter(reads, lambda r: r["error"].isNotNull())
        first = F.coalesce(F.get(F.filter(wrong, lambda r: ~r["late"]), F.lit(0))["error"], F.get(wrong, F.lit(0))["error"])
        return F.struct(F.transform(reads, lambda r: r["value"]).alias("values"), first.alias("error")).cast(kind)

    return bind(F.transform(args, read), ended)


def _with_late(read: Column, late: bool) -> Column:
    return bind(read, lambda r: F.struct(r["value"].alias("value"), r["error"].alias("error"), F.lit(late).alias("late")))


def log_values(layout: Column, topics: Column, data: Column, raw: Column) -> Column:
    """(values, error) of a log by a layout. topics: all, in lower case; raw: the data's bytes."""
    k = F.size(topics) - 1
    words = F.when(k > 0, layout["words"]).otherwise(layout["words_all"])
    zeros = (data == "0x") & (words > 0)
    body = F.when(zeros, F.unhex(F.repeat(F.lit("00"), words * 32))).otherwise(raw)
    none = F.array().cast("array<string>")
    stop = lambda error: F.struct(none.alias("values"), error.alias("error"))

    def topic(arg: Column) -> Column:
        text = F.get(topics, arg["topic"] + 1)

        def read(raw: Column) -> Column:
            kept = _read(F.concat(F.lit("0x"), F.lower(F.hex(raw))), F.lit(None).cast("string"))
            error = _hexed_error(text, raw)
            return F.when(error.isNotNull(), _failed(error)).when(arg["stands"], read_word(F.get(arg["leaves"], F.lit(0)), raw, F.lit(0))).otherwise(kept)

        return bind(as_binary(text), read)

    def read(body: Column) -> Column:
        one = lambda arg: F.when((k > 0) & arg["topic"].isNotNull(), _with_late(topic(arg), True)).otherwise(
            _with_late(read_input(arg, body, F.when(k > 0, arg["head"]).otherwise(arg["head_all"])), False)
        )
        error = _hexed_error(data, body)
        return F.when(error.isNotNull(), stop(error)).otherwise(_values(layout["args"], one))

    mismatch = (k > 0) & (layout["indexed"] != k)
    return F.when(mismatch, stop(_text("EventError: ", layout["indexed"], " indexed inputs, ", k, " topics for them"))).otherwise(bind(body, read))


def call_values(layout: Column, data: Column, raw: Column) -> Column:
    """(values, error) of a call's input, whose first four bytes are the selector."""
    none = F.array().cast("array<string>")
    error = _hexed_error(data, raw)
    read = lambda body: _values(layout["args"], lambda arg: _with_late(read_input(arg, body, arg["head"]), False))
    body = F.substr(raw, F.lit(5))
    return F.when(error.isNotNull(), F.struct(none.alias("values"), error.alias("error"))).otherwise(bind(body, read))


EVENT = "struct<name:string,params:map<string,string>,undecoded_params:array<string>,decoded:boolean,abi_source:string,decode_error:string>"
CALL = "struct<name:string,params:map<string,string>,decoded:boolean,decode_error:string>"


def _outcome(kind: str, **known: Column) -> Column:
    """A struct of the kind; what is not known is null."""
    fields = [f.split(":")[0] for f in re.findall(r"\w+:(?:\w+<[^>]*>|\w+)", kind.removeprefix("struct<"))]
    return F.struct(*[known.get(f, F.lit(None)).alias(f) for f in fields]).cast(kind)


def read_log(topics: Column, data: Column, raw: Column, candidates: Column) -> Column:
    """EVENT of a log: by the first of the candidates that it fits, or the errors of all."""

    def attempt(have: Column, layout: Column) -> Column:
        def ended(r: Column) -> Column:
            params = F.transform(layout["args"], lambda a: a["param"])
            encoded = F.transform(F.filter(layout["args"], lambda a: ~a["stands"] & (F.size(topics) > 1)), lambda a: a["param"])
            good = _outcome(EVENT, name=layout["name"], params=F.map_from_arrays(params, r["values"]), undecoded_params=encoded, decoded=F.lit(True), abi_source=layout["source"])
            error = F.concat_ws("; ", have["decode_error"], _text(layout["source"], ": ", r["error"]))
            return F.when(r["error"].isNull(), good).otherwise(_outcome(EVENT, decoded=F.lit(False), decode_error=error))

        return F.when(have["decoded"], have).otherwise(bind(log_values(layout, topics, data, raw), ended))

    anonymous = topics.isNull() | (F.size(topics) == 0)
    empty = F.when(F.size(candidates) == 0, F.lit("unknown topic"))
    tried = F.aggregate(candidates, _outcome(EVENT, decoded=F.lit(False), decode_error=empty), attempt)
    return F.when(anonymous, _outcome(EVENT, decoded=F.lit(False), decode_error=F.lit("anonymous event"))).otherwise(tried)


def read_call(data: Column, raw: Column, layout: Column) -> Column:
    """CALL of a call by a layout, or by none."""

    def ended(r: Column) -> Column:
        params = F.transform(layout["args"], lambda a: a["param"])
        good = _outcome(CALL, name=layout["name"], params=F.map_from_arrays(params, r["values"]), decoded=F.lit(True))
        return F.when(r["error"].isNull(), good).otherwise(_outcome(CALL, decoded=F.lit(False), decode_error=r["error"]))

    unknown = _outcome(CALL, decoded=F.lit(False), decode_error=F.lit("unknown function"))
    return F.when(layout.isNull(), unknown).otherwise(bind(call_values(layout, data, raw), ended))
