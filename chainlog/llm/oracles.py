"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

from . import licenses, mixing, quality, spotsigs, url_filter
from .common import STOP_WORDS


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _quality() -> str:
    bad = []
    for r in quality.RULES:
        tests = [f"1000 * {r.part} < {r.low} * {r.whole}"] * (r.low is not None) + [f"1000 * {r.part} > {r.high} * {r.whole}"] * (r.high is not None)
        bad += [f"n_words >= {r.from_words} AND {t}" for t in tests]
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_words("text")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (
  SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM dup WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains({_strings(STOP_WORDS)}, lower(rtrim(x, '.,;:!?')))))::BIGINT AS n_stop_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"({x})" for x in bad)}) AS kept
FROM b"""


def _urls() -> str:
    cases = [
        f"WHEN (h = '{r.host}' OR ends_with(h, '.{r.host}')) AND starts_with(p, '{r.path}') THEN '{r.text}={r.verdict}'"
        for r in sorted(url_filter.RULES, key=lambda r: -len(r.text))
    ]
    listed = " OR ".join(f"h = '{x}' OR ends_with(h, '.{x}')" for x in url_filter.LISTED_HOSTS)
    return rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS h,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS p
  FROM pages
),
f AS (SELECT *, CASE {" ".join(cases)} END AS fit FROM u)
SELECT page_id, h AS host, p AS path, string_split(fit, '=')[1] AS rule,
       coalesce(string_split(fit, '=')[2], CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict
FROM f"""


def _preferences() -> str:
    turn = "'<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10)"
    return rf"""
WITH last AS (
  SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id
),
swapped AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.turn = m.turn THEN o.text ELSE c.text END AS text
  FROM conversations c LEFT JOIN last m ON m.conv_id = c.conv_id LEFT JOIN last o ON o.conv_id = xor(c.conv_id, 1)
  WHERE NOT coalesce(c.role = 'assistant' AND c.turn = m.turn, false) OR o.conv_id IS NOT NULL
),
both_sides AS (
  SELECT DISTINCT conv_id AS pair_id, turn, role, text, 'chosen' AS side FROM conversations
  UNION ALL SELECT DISTINCT conv_id, turn, role, text, 'rejected' FROM swapped
),
turns AS (
  SELECT pair_id, turn, list({turn} ORDER BY role, text) FILTER (side = 'chosen') AS c, list({turn} ORDER BY role, text) FILTER (side = 'rejected') AS r
  FROM both_sides GROUP BY pair_id, turn
),
cut AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS cut FROM turns GROUP BY pair_id),
said AS (
  SELECT b.*, {turn} AS t, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE side END AS section
  FROM both_sides b JOIN cut ON cut.pair_id = b.pair_id
  WHERE side = 'chosen' OR cut IS NOT NULL AND turn >= cut
),
placed AS (
  SELECT *, turn // 64 AS part, coalesce(sum(length(t)) OVER (
    PARTITION BY pair_id, section, turn // 64 ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM said
)
SELECT pair_id, section, part::BIGINT AS part, min(turn) AS first_turn, count(*)::INTEGER AS n_turns,
       string_agg(t, '' ORDER BY turn, role, text) AS text,
       '[' || coalesce(string_agg('{{"start":' || (place + length(role) + 5) || ',"end":' || (place + length(t)) || '}}', ',' ORDER BY turn, role, text)
         FILTER (section <> 'prompt' AND role = 'assistant'), '') || ']' AS targets
FROM placed GROUP BY pair_id, section, part"""




def _spotsigs() -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS nxt
  FROM documents
),
e AS (SELECT doc_id, text, nxt, left(text, length(text) - length(text) // 2) || left(nxt, length(text) // 2) AS edited FROM d),
v AS (SELECT doc_id, 'a' AS k, text AS t FROM e UNION ALL SELECT doc_id, 'b', edited FROM e UNION ALL SELECT doc_id, 'c', nxt FROM e),
w AS (SELECT doc_id, k, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM v),
x AS (SELECT doc_id, k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
y AS (SELECT doc_id, k, x, i, list_contains({_strings(STOP_WORDS)}, x) AS anchor FROM x),
z AS (SELECT doc_id, k, x, anchor, sum((NOT anchor)::INTEGER) OVER (PARTITION BY doc_id, k ORDER BY i) AS n FROM y),
c AS (SELECT doc_id, k, n, x, lead(x) OVER (PARTITION BY doc_id, k ORDER BY n) AS x2 FROM z WHERE NOT anchor),
s AS (
  SELECT DISTINCT z.doc_id, z.k, left(md5(z.x || ' ' || c.x || ' ' || c.x2), 8) AS h
  FROM z JOIN c ON c.doc_id = z.doc_id AND c.k = z.k AND c.n = z.n + 1 WHERE z.anchor AND c.x2 IS NOT NULL
),
l AS (SELECT doc_id, k, list(h ORDER BY h) AS l FROM s GROUP BY doc_id, k),
f AS (SELECT v.doc_id, v.k, coalesce(l.l, [left(md5(v.t), 8)]) AS l FROM v LEFT JOIN l ON l.doc_id = v.doc_id AND l.k = v.k)
SELECT e.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256,
       array_to_string(a.l, '') AS fingerprint, array_to_string(b.l, '') AS edited_fingerprint,
       len(list_intersect(a.l, b.l))::DOUBLE / (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l))) AS near_edited,
       len(list_intersect(a.l, c.l))::DOUBLE / (len(a.l) + len(c.l) - len(list_intersect(a.l, c.l))) AS near_next
FROM e JOIN f a ON a.doc_id = e.doc_id AND a.k = 'a' JOIN f b ON b.doc_id = e.doc_id AND b.k = 'b' JOIN f c ON c.doc_id = e.doc_id AND c.k = 'c'"""


def _licenses() -> str:
    t = licenses.THRESHOLD
    rows = []
    for name in sorted(licenses.TEMPLATES):
        own = licenses.template_bigrams(licenses.TEMPLATES[name])
        low, high = licenses.size_bounds(len(own), t)
        rows.append(f"('{name}', {_strings(own)}, {low}, {high}, {len(licenses.template_words(licenses.TEMPLATES[name])) - 2})")
    return rf"""
WITH t(name, g, low, high, reach) AS (VALUES {", ".join(rows)}),
tg AS (SELECT name, low, reach, unnest(g) AS g FROM t),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT doc_id, [w[j] || ' ' || w[j + 1] for j in range(1, len(w))] AS g FROM w WHERE len(w) > 1),
u AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS at FROM b),
h AS (SELECT u.doc_id, u.at, tg.name, tg.low, tg.reach FROM u JOIN tg ON tg.g = u.g),
c AS (
  SELECT a.doc_id, a.name, a.at AS s, max(z.at) AS e
  FROM h a JOIN h z ON z.doc_id = a.doc_id AND z.name = a.name AND z.at BETWEEN a.at AND a.at + a.reach
  GROUP BY a.doc_id, a.name, a.at, a.low HAVING count(*) >= a.low
),
x AS (
  SELECT c.doc_id, c.name, s, e - s + 2 AS n, len(list_distinct(b.g[s:e])) AS size, t.low, t.high,
         2.0::DOUBLE * len(list_intersect(list_distinct(b.g[s:e]), t.g)) / (len(list_distinct(b.g[s:e])) + len(t.g)) AS dice
  FROM c JOIN b ON b.doc_id = c.doc_id JOIN t ON t.name = c.name
),
y AS (SELECT *, max(s + n) OVER (PARTITION BY doc_id, name ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM x WHERE size BETWEEN low AND high AND dice >= {t}::DOUBLE),
r AS (SELECT *, sum((before IS NULL OR s >= before)::INTEGER) OVER (PARTITION BY doc_id, name ORDER BY s) AS run FROM y),
best AS (SELECT doc_id, name, s, n, dice FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, name, run ORDER BY dice DESC, n DESC, s) = 1),
kept AS (
  SELECT * FROM best a WHERE NOT EXISTS (
    SELECT 1 FROM best o WHERE o.doc_id = a.doc_id AND o.s < a.s + a.n AND a.s < o.s + o.n
      AND (o.dice * o.n, o.dice, -o.s) >= (a.dice * a.n, a.dice, -a.s) AND ((o.dice * o.n, o.dice, -o.s) <> (a.dice * a.n, a.dice, -a.s) OR o.name < a.name))
),
top AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice * n DESC, dice DESC, s, name DESC) = 1),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_license_spans, top.name AS license, top.s::BIGINT AS start_word, top.n::BIGINT AS n_words, top.dice,
       coalesce(n.names, '') AS licenses
FROM documents d LEFT JOIN top ON top.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def _mix() -> str:
    m = mixing.Mix()
    held = "s AS (SELECT source, n, r, w, {k} * n AS cap, false AS held, 0.0::DOUBLE AS t FROM w)".replace("{k}", str(m.max_repeats))
    rounds = []  # each round holds the sources above their limit; as many rounds as there can be are more than are needed
    last = "s"
    for i in range(24):
        rounds.append(
            f"r{i} AS (SELECT source, n, r, w, cap, held, CASE WHEN held THEN cap::DOUBLE ELSE "
            f"((SELECT sum(n) FROM {last}) - coalesce((SELECT sum(cap) FROM {last} WHERE held), 0))::DOUBLE * w / (SELECT sum(w) FROM {last} WHERE NOT held) END AS t FROM {last}), "
            f"h{i} AS (SELECT source, n, r, w, cap, held OR t > cap AS held, t FROM r{i})"
        )
        last = f"h{i}"
    return rf"""
WITH z AS (SELECT doc_id, source, len({_words("text")})::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS n FROM z GROUP BY source),
w AS (SELECT source, n, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS r,
  {_strings(map(str, m.weights))}[1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % {len(m.weights)}]::BIGINT AS w FROM g),
{held},
{", ".join(rounds)},
b AS (SELECT *, pow(10, greatest(length(size::VARCHAR) - 2, 0))::BIGINT AS u, md5('{m.seed}' || coalesce(doc_id::VARCHAR, '')) AS h FROM z),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size // u * u, h, doc_id) - 1 AS k FROM b),
o AS (
  SELECT k.doc_id, k.size, f.n AS source_size, f.t AS target, k.k, CASE WHEN f.n = 0 THEN 0 ELSE f.t / f.n END AS rate,
         ('0x' || left(md5('{m.seed}/' || coalesce(k.source, '')), 4))::INTEGER::DOUBLE / 65536 AS off
  FROM k JOIN {last} f ON f.source IS NOT DISTINCT FROM k.source
)
SELECT doc_id, size, source_size, target, (least(floor((k + 1) * rate + off) - floor(k * rate + off), {m.max_repeats}) * size)::BIGINT AS taken FROM o"""


def _crc32(text: str) -> str:
    """Of ASCII text, by bytes, with the table of the reflected polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"


def _merkle() -> str:
    """For subsets of up to 16 ** 5 rows, and up to 16 ** 4 subsets."""
    field = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}, '-')"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree, sha256({head} || {field("text")}) AS digest,
          CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN sha256({head} || {field(lowered)}) END AS tampered FROM documents)""",
        """a0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n, digest, doc_id, tampered FROM d)""",
    ]

    def grow(name: str, height: int) -> str:
        for k in range(height):
            run = "PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN"
            parts.append(f"""{name}_step{k} AS (SELECT tree, place, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
              coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)""")
            parts.append(f"""{name}{k + 1} AS (SELECT tree, place // 16 AS place, (max(n) + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY tree, place // 16)""")
        return " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE n = 1" for k in range(height + 1))

    parts.append(f"subroots AS ({grow('a', 5)})")
    parts.append("b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, digest, tree AS name FROM subroots)")
    parts.append(f"roots AS ({grow('b', 4)})")
    joins = [f"LEFT JOIN a_step{k} ON a_step{k}.tree = a0.tree AND a_step{k}.place = a0.place // {16**k}" for k in range(5)]
    joins += ["JOIN b0 ON b0.name = a0.tree"] + [f"LEFT JOIN b_step{k} ON b_step{k}.place = b0.place // {16**k}" for k in range(4)]
    steps = [f"a_step{k}" for k in range(5)] + [f"b_step{k}" for k in range(4)]
    end = "coalesce(a0.tampered, a0.digest)"
    parts.append(f"""steps AS (SELECT a0.doc_id, a0.digest AS leaf, b0.digest AS subroot, {end} AS f0, {", ".join(f"{s}.l AS l{i}, {s}.r AS r{i}" for i, s in enumerate(steps))} FROM a0 {" ".join(joins)})""")
    for i in range(len(steps)):
        have = "steps" if not i else f"folds{i}"
        parts.append(f"folds{i + 1} AS (SELECT *, CASE WHEN l{i} IS NULL THEN f{i} ELSE sha256(l{i} || f{i} || r{i}) END AS f{i + 1} FROM {have})")
    siblings = " || ".join(f"coalesce(l{i} || r{i}, '')" for i in range(len(steps)))
    last = len(steps)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, (SELECT digest FROM roots) AS root, sha256({siblings}) AS proof_sha256, f{last} AS folded_root, f{last} = (SELECT digest FROM roots) AS verified FROM folds{last}"""


def _divergence() -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    share = lambda n, total: f"(1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + v.terms))::HUGEINT"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {lowered} AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS terms, sum(total) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source
      LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "s.total")} AS p, {share("k.total", "v.total")} AS q
      FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C"))::INTEGER AS rank FROM e QUALIFY part = 'pair' OR rank <= 200"""


ORACLES = {
    "op3_bloom_cascade": _urls(),
    "op4_preference_format": _preferences(),
    "op5_spotsigs": _spotsigs(),
    "op6_quality_rules": _quality(),
    "op8_license_dice": _licenses(),
    "op10_systematic_mix": _mix(),
    "op11_merkle_manifest": _merkle(),
    "op12_source_divergence": _divergence(),
}
