"""The pseudonyms' query against plain Python, value by value and text by text."""

import datetime
import hashlib
import json
import re
from pathlib import Path

from chainlog.llm import pseudonyms as p
from chainlog.llm.queries import op2_feistel_pseudonyms

EMAIL, IP, DATE, SSN, PHONE, CARD = (re.compile(x, re.ASCII) for x in (p.EMAIL, p.IP, p.DATE, p.SSN, p.PHONE, p.CARD))
OTHERS = re.compile(r"(?<= )(?:" + "|".join((p.IP, p.DATE, p.SSN, r"[A-Za-z0-9][A-Za-z0-9._%+-]*@")) + ")", re.ASCII)
WORD = re.compile(r"\w", re.ASCII)
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def digits(v):
    return "".join(c for c in v if c in CLASSES[2])


def luhn(v):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits(v)))) % 10 == 0


def pad(key, purpose, step, half):
    return hashlib.sha256(f"{key}/{purpose}/{step}/{half}".encode()).hexdigest()


def move_text(v, key, purpose):
    if len(v) < 2:
        return v
    shape = "".join(next((a[0] for a in CLASSES if c in a), c) for c in v)
    halves = [v[: len(v) // 2], v[len(v) // 2 :]]
    for step in range(8):
        own, other, out = halves[step % 2], halves[1 - step % 2], ""
        for i, c in enumerate(own):
            hexes = pad(key, purpose, step, f"{i // 16}/{shape}/{other}")
            by = int(hexes[i % 16 * 4 : i % 16 * 4 + 4], 16)
            out += next((a[(a.index(c) + by) % len(a)] for a in CLASSES if c in a), c)
        halves[step % 2] = out
    return "".join(halves)


def move_number(n, key, purpose, left, right):
    halves, sizes = list(divmod(n, right)), (left, right)
    for step in range(8):
        k = step % 2
        halves[k] = (halves[k] + int(pad(key, purpose, step, halves[1 - k])[:12], 16)) % sizes[k]
    return halves[0] * right + halves[1]


def refill(v, new):
    new = iter(new)
    return "".join(next(new) if c in CLASSES[2] else c for c in v)


def new_date(v, key):
    form = "%Y-%m-%d" if v[4] == "-" else "%d/%m/%Y" if v[2] == "/" else "%d.%m.%Y"
    try:
        day = datetime.datetime.strptime(v, form).date()
    except ValueError:
        return v
    first = day.replace(month=1, day=1)
    leap = day.replace(month=12, day=31).timetuple().tm_yday == 366
    moved = move_number((day - first).days, key, "leap year" if leap else "common year", *((6, 61) if leap else (5, 73)))
    return (first + datetime.timedelta(moved)).strftime(form)


def new_value(v, key):
    """(kind, pseudonym)"""
    if EMAIL.fullmatch(v):
        name, _, top = v.rpartition(".")
        return "email", move_text(name, key, "email") + "." + top
    if IP.fullmatch(v):
        n = move_number(int.from_bytes(bytes(map(int, v.split("."))), "big"), key, "ip", 1 << 16, 1 << 16)
        return "ip", ".".join(map(str, n.to_bytes(4, "big")))
    if DATE.fullmatch(v):
        return "date", new_date(v, key)
    if SSN.fullmatch(v):
        areas = [a for a in range(1, 900) if a != 666]
        n = (areas.index(int(v[:3])) * 99 + int(v[4:6]) - 1) * 9999 + int(v[7:]) - 1
        n = move_number(n, key, "ssn", 898 * 99, 9999)
        return "ssn", f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if v[0] == "+":
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", v).group()
        return "phone", code + refill(v[len(code) :], move_text(digits(v[len(code) :]), key, "phone"))
    body = move_text(digits(v)[:-1], key, "card")
    return "card", refill(v, body + next(c for c in CLASSES[2] if luhn(body + c)))


def ends(text, i, good):
    """The values that start at i and validate, longest first; those that reach into another value only if there are no others."""
    found = [text[i:j] for j in range(min(len(text), i + 60), i, -1) if good(text[i:j], text[j:])]
    other = OTHERS.search(text, i)
    own = [v for v in found if not other or i + len(v) <= other.start()]
    return own or found


def is_card(v, rest):
    return bool(re.fullmatch(r"\d(?:[ -]?\d){12,18}", v, re.ASCII)) and luhn(v) and not re.match(r"[\w-]|\.\d", rest, re.ASCII)


def is_phone(v, rest):
    return bool(PHONE.fullmatch(v)) and 8 <= len(digits(v)) <= 15 and not WORD.match(rest)


def number_at(text, i):
    before = text[i - 1] if i else " "
    if text[i] == "+" and not WORD.match(before) and before != "+":
        found = ends(text, i, is_phone)
        return next((v for v in found if text[i + len(v) : i + len(v) + 1] == " " and ends(text, i + len(v) + 1, is_card)), found[0] if found else None)
    if text[i] in CLASSES[2] and not WORD.match(before) and before not in ".+-":
        return next(iter(ends(text, i, is_card)), None)
    return None


def slow(text, key):
    """(text with pseudonyms, number of changed values by kind)"""
    fixed, at, out, counts = re.compile(f"{p.EMAIL}|{p.IP}|{p.DATE}|{p.SSN}", re.ASCII), 0, "", {}
    while at < len(text):
        m = fixed.search(text, at)
        upto = m.start() if m else len(text)
        starts = (x.start() for x in re.finditer(r"[+0-9]", text[at:upto]))
        start, v = next(((at + i, number_at(text, at + i)) for i in starts if number_at(text, at + i)), (upto, m.group() if m else ""))
        kind, new = new_value(v, key) if v else (None, "")
        out += text[at:start] + new
        if v != new:
            counts[kind] = counts.get(kind, 0) + 1
        at = start + len(v)
    return out, counts


def test_query_over_documents(spark, sf_dir):
    sf_dir = str(Path(sf_dir).with_name("sf0.01"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_feistel_pseudonyms(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    total = {}
    for r in rows:
        text, counts = (None, {}) if texts[r["doc_id"]] is None else slow(texts[r["doc_id"]], p.OPEN_KEY)
        assert (r["text"], json.loads(r["replaced"])) == (text, counts), r["doc_id"]
        for k, n in counts.items():
            total[k] = total.get(k, 0) + n
    assert sum(total.values()) > 50 and len(total) >= 3


def test_every_format(spark):
    texts = [
        "a Bob.7x@sub1.Mail-9.example.org, b", "long.name.of-someone+tag_12345@a-very-long-domain-name.example.com", "0.0.0.0 255.255.255.255 10.20.30.40:80",
        "2024-02-29 2023-12-31 01/01/1900 31.12.2099 2023-02-29", "001-01-0001 665-99-9999 667-10-0042 899-99-9999 666-10-1000", "+33 1 23 45 67 89 +1 (826) 555-4081; +4412345678",
        "4111111111111111 4111-1111-1111-1111 378282246310005 4111111111111112", "+1 (826) 555-4081 190.137.223.204 4111 1111 1111 1111 12/25", "Zoë +298 123456 é 123-45-6789", "", "no value",
    ]
    for key in ("k", "other key"):
        got = p.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key=key).orderBy("doc_id").collect()
        assert [r["text"] for r in got] == [slow(t, key)[0] for t in texts]


def test_key_of_the_session(spark):
    df = spark.createDataFrame([("10.20.30.40",)], "text string")
    spark.conf.set(p.KEY_SETTING, "mine")
    try:
        assert p.pseudonymise(df).first()["text"] == slow("10.20.30.40", "mine")[0]
    finally:
        spark.conf.unset(p.KEY_SETTING)
    assert p.pseudonymise(df).first()["text"] == slow("10.20.30.40", p.OPEN_KEY)[0]
