"""The contract ABI: types, event topics, function selectors, and decoding of event data and call inputs."""

from __future__ import annotations

import json
import re

from .keccak import keccak256

WORD = 32


class AbiError(ValueError):
    """An ABI entry that makes no sense."""


class EventError(ValueError):
    """A log that does not fit its ABI entry."""


class ShortData(EventError):
    """Data that end before a value does."""


class BadPadding(EventError):
    """Bytes that should be padding but are not."""


class UnknownEvent(EventError):
    """A topic that the ABI does not have."""


class StructLogError(ValueError):
    """A step of an opcode trace that cannot be read."""


def type_of(param: dict) -> str:
    """The canonical type: a tuple's components in brackets, with its array suffix (of nested arrays the first only)."""
    kind = param["type"]
    if kind.startswith("tuple"):
        suffix = re.match(r"\[\d*\]", kind[5:])
        return f"({','.join(type_of(c) for c in param['components'])}){suffix[0] if suffix else ''}"
    return kind


def signature(entry: dict) -> str:
    return f"{entry['name']}({','.join(type_of(p) for p in entry['inputs'])})"


def event_topic(entry: dict) -> str:
    if not isinstance(entry, dict):
        raise TypeError("an event's ABI entry must be a dictionary")
    if entry.get("anonymous"):
        raise AbiError("an anonymous event has no topic")
    return "0x" + keccak256(signature(entry).encode()).hex()


def selector(entry: dict) -> str:
    return "0x" + keccak256(signature(entry).encode())[:4].hex()


def topic_map(abi: list) -> dict[str, dict]:
    """Event entries by topic; of entries with one topic the last counts."""
    try:
        return {event_topic(e): e for e in abi if e["type"] == "event" and not e.get("anonymous")}
    except (KeyError, TypeError) as e:
        raise AbiError("invalid ABI") from e


def selector_map(abi: list) -> dict[str, dict]:
    try:
        return {selector(e): e for e in abi if e.get("type", "function") == "function"}
    except (KeyError, TypeError, AttributeError) as e:
        raise AbiError("invalid ABI") from e


def _split(inner: str) -> list[str]:
    """The types of a tuple's inside, at its top level."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(inner[last:i])
            last = i + 1
    return out + [inner[last:]] if inner else []


def _array(kind: str) -> tuple[str, int | None] | None:
    """(item type, length or None for any) of an array type."""
    m = re.fullmatch(r"(.+)\[(\d*)\]", kind)
    return (m[1], int(m[2]) if m[2] else None) if m else None


def is_dynamic(kind: str) -> bool:
    if a := _array(kind):
        return a[1] is None or is_dynamic(a[0])
    if kind.startswith("("):
        return any(map(is_dynamic, _split(kind[1:-1])))
    return kind in ("bytes", "string")


def _head_size(kind: str) -> int:
    if is_dynamic(kind):
        return WORD
    if a := _array(kind):
        return a[1] * _head_size(a[0])
    if kind.startswith("("):
        return sum(map(_head_size, _split(kind[1:-1])))
    return WORD


def _sized(n: int) -> str:
    """A number as errors show it: in hex where no data are so long."""
    return str(n) if n < 16**7 else hex(n)


def _take(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ShortData(f"{_sized(n)} bytes wanted at {_sized(at)}, {len(data)} are there")
    return data[at : at + n]


def _sequence(kinds: list[str], data: bytes, at: int) -> list:
    out, head = [], at
    for kind in kinds:
        if is_dynamic(kind):
            out.append(_value(kind, data, at + int.from_bytes(_take(data, head, WORD), "big")))
        else:
            out.append(_value(kind, data, head))
        head += _head_size(kind)
    return out


def _value(kind: str, data: bytes, at: int):
    if a := _array(kind):
        item, n = a
        if n is None:
            n = int.from_bytes(_take(data, at, WORD), "big")
            at += WORD
            if n * _head_size(item) > len(data) - at:
                raise ShortData(f"an array of {_sized(n)} items does not fit")
        return _sequence([item] * n, data, at)
    if kind.startswith("("):
        return tuple(_sequence(_split(kind[1:-1]), data, at))
    if kind in ("bytes", "string"):
        n = int.from_bytes(_take(data, at, WORD), "big")
        body = _take(data, at + WORD, n)
        pad = _take(data, at + WORD + n, -n % WORD)
        if any(pad):
            raise BadPadding("bytes after the value are not zero")
        try:
            return body if kind == "bytes" else body.decode("utf-8")
        except UnicodeDecodeError as e:
            raise EventError("bytes are no UTF-8 text") from e
    word = _take(data, at, WORD)
    if kind == "address":
        if any(word[:12]):
            raise BadPadding("bytes before an address are not zero")
        return "0x" + word[12:].hex()
    if kind == "bool":
        if any(word[:31]) or word[31] > 1:
            raise BadPadding("a truth value is neither 0 nor 1")
        return bool(word[31])
    if m := re.fullmatch(r"(u?)int(\d*)", kind):
        n = int(m[2] or 256) // 8
        if m[1]:
            if any(word[: WORD - n]):
                raise BadPadding("bytes before a number are not zero")
            return int.from_bytes(word, "big")
        number = int.from_bytes(word[WORD - n :], "big", signed=True)
        if any(b != (255 if number < 0 else 0) for b in word[: WORD - n]):
            raise BadPadding("bytes before a number do not continue its sign")
        return number
    if m := re.fullmatch(r"bytes(\d+)", kind):
        n = int(m[1])
        if not 1 <= n <= 32:
            raise AbiError(f"unknown type {kind}")
        if any(word[n:]):
            raise BadPadding("bytes after the value are not zero")
        return word[:n]
    if kind == "function":
        return word[:24]
    raise AbiError(f"unknown type {kind}")


def decode_values(kinds: list[str], data: bytes) -> list:
    return _sequence(kinds, data, 0)


def as_bytes(text: str | None) -> bytes:
    if text is None:
        raise EventError("no data")
    digits = text[2:] if text[:2] in ("0x", "0X") else text
    if len(digits) % 2 or not re.fullmatch("[0-9a-fA-F]*", digits):
        raise EventError("no hex text")
    return bytes.fromhex(digits)


def in_topic(kind: str) -> bool:
    """Whether an indexed value of this type stands in its topic; of others (dynamic ones, arrays, tuples) the topic is a hash."""
    return not (is_dynamic(kind) or _array(kind) or kind.startswith("("))


def names_of(inputs: list[dict]) -> list[str]:
    """The inputs' names; one without a name is arg and its position, from 0."""
    return [p.get("name") or f"arg{i}" for i, p in enumerate(inputs)]


def shown(value) -> str:
    """Canonical text: numbers in decimal, addresses and bytes in lower-case hex, arrays and tuples as JSON."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, bytes):
        return "0x" + value.hex()
    if isinstance(value, (list, tuple)):
        return json.dumps([_plain(v) for v in value], separators=(",", ":"))
    return str(value)


def _plain(value):
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else shown(value)


def decode_log(entry: dict, topics: list[str], data: str) -> list[tuple[str, str, bool]]:
    """(name, value, decoded) of an event's inputs; topics without the first.

    A log without topics for an entry with indexed inputs has them all in its data. Data of 0x count as zeros. Of an indexed
    value that takes more than a topic there is a hash, which stays as it is, not decoded.
    """
    inputs = [(name, type_of(p), bool(p.get("indexed"))) for name, p in zip(names_of(entry["inputs"]), entry["inputs"])]
    n = sum(indexed for _, _, indexed in inputs)
    if topics and n != len(topics) or n < len(topics):
        raise EventError(f"{n} indexed inputs, {len(topics)} topics for them")
    kinds = [kind for _, kind, indexed in inputs if not (topics and indexed)]
    body = bytes(WORD * len(kinds)) if kinds and data == "0x" else as_bytes(data)
    values, words = iter(decode_values(kinds, body)), iter(topics)
    out = []
    for name, kind, indexed in inputs:
        if not (topics and indexed):
            out.append((name, shown(next(values)), True))
            continue
        word = as_bytes(next(words))
        stands = in_topic(kind)
        out.append((name, shown(_value(kind, word, 0) if stands else word), stands))
    return out


def decode_call(entry: dict, data: str) -> list[tuple[str, str]]:
    """(name, value) of a call's inputs; data with the selector."""
    kinds = [type_of(p) for p in entry["inputs"]]
    return [(name, shown(v)) for name, v in zip(names_of(entry["inputs"]), decode_values(kinds, as_bytes(data)[4:]))]


def encode_values(kinds: list[str], values: list) -> bytes:
    """The inverse of decode_values, for making captured data and tests."""
    heads, tails = [], []
    size = sum(map(_head_size, kinds))
    for kind, value in zip(kinds, values, strict=True):
        body = _encoded(kind, value)
        if is_dynamic(kind):
            heads.append((size + sum(map(len, tails))).to_bytes(WORD, "big"))
            tails.append(body)
        else:
            heads.append(body)
    return b"".join(heads + tails)


def _encoded(kind: str, value) -> bytes:
    if a := _array(kind):
        body = encode_values([a[0]] * len(value), list(value))
        return body if a[1] is not None else len(value).to_bytes(WORD, "big") + body
    if kind.startswith("("):
        return encode_values(_split(kind[1:-1]), list(value))
    if kind in ("bytes", "string"):
        raw = value if kind == "bytes" else value.encode()
        return len(raw).to_bytes(WORD, "big") + raw + bytes(-len(raw) % WORD)
    if kind == "address":
        return as_bytes(value).rjust(WORD, b"\0")
    if kind.startswith("bytes") or kind == "function":
        return value.ljust(WORD, b"\0")
    return int(value).to_bytes(WORD, "big", signed=kind.startswith("int"))


def _event(name: str, *inputs: str) -> dict:
    """An event entry from inputs like 'address indexed _from'."""
    parts = [i.split() for i in inputs]
    return {"type": "event", "name": name, "anonymous": False, "inputs": [{"name": p[-1], "type": p[0], "indexed": "indexed" in p} for p in parts]}


#: Standard events in the order in which they are tried. Fixed values of the public token standards.
FALLBACK_ABIS = {
    "ABI_ERC_20": [
        _event("Transfer", "address indexed _from", "address indexed _to", "uint256 _value"),
        _event("Approval", "address indexed _owner", "address indexed _spender", "uint256 _value"),
    ],
    "ABI_ERC_721": [
        _event("Transfer", "address indexed _from", "address indexed _to", "uint256 indexed _tokenId"),
        _event("Approval", "address indexed _owner", "address indexed _approved", "uint256 indexed _tokenId"),
        _event("ApprovalForAll", "address indexed _owner", "address indexed _operator", "bool _approved"),
    ],
    "ABI_ERC_777": [
        _event("Sent", "address indexed operator", "address indexed from", "address indexed to", "uint256 amount", "bytes data", "bytes operatorData"),
        _event("Minted", "address indexed operator", "address indexed to", "uint256 amount", "bytes data", "bytes operatorData"),
        _event("Burned", "address indexed operator", "address indexed from", "uint256 amount", "bytes data", "bytes operatorData"),
        _event("AuthorizedOperator", "address indexed operator", "address indexed holder"),
        _event("RevokedOperator", "address indexed operator", "address indexed holder"),
    ],
    "ABI_ERC_1155": [
        _event("TransferSingle", "address indexed _operator", "address indexed _from", "address indexed _to", "uint256 _id", "uint256 _value"),
        _event("TransferBatch", "address indexed _operator", "address indexed _from", "address indexed _to", "uint256[] _ids", "uint256[] _values"),
        _event("ApprovalForAll", "address indexed _owner", "address indexed _operator", "bool _approved"),
        _event("URI", "string _value", "uint256 indexed _id"),
    ],
    "ABI_Augur": [
        _event("Mint", "address indexed target", "uint256 value"),
        _event("Burn", "address indexed target", "uint256 value"),
    ],
}
