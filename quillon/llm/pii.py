"""Personal data in text, with built-in functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and ranges confirm them, and words in the 40
characters before a span raise or lower its score. Starts come from splitting a text at the matches of the same
pattern: a match begins after all pieces and matches before it, which is a running sum over them, taken in chunks of
chunks so that its cost follows their number. Offsets are code points.

The patterns are written so that no text makes them slow: a run of characters is entered only at its first
character, or where the match before ended (\\G), and is never given back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
# Kind, pattern, pattern that a text must contain to be searched at all.
PATTERNS = [
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", r"[0-9](?:[ -]?[0-9])++", None),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", None),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    ("secret", r"(?<![A-Za-z0-9_-])(?:[A-Fa-f0-9]{16,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)(?![A-Za-z0-9_-])", None),
]
# What a kind scores by itself, the words before it that add 0.4, and those that take 0.4 away.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.2}
CONTEXT = {
    "email": "e-?mail|contact|mailto",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social|security|tax",
    "secret": "password|passwd|pwd|token|secret|api.?key|access.?key|bearer|credential",
}
AGAINST = {
    "email": "example|noreply",
    "ip": "version|release|build",
    "card": "order|invoice|tracking",
    "phone": "order|invoice|isbn",
    "iban": "example|sample",
    "ssn": "order|invoice|part no|isbn",
    "secret": "checksum|sha-?1|sha-?256|md5|commit|digest",
}
# Forms of a secret that need no word beside them.
KEYS = "^(?:AKIA|gh[pousr]_|sk-|eyJ)"
BASE, KEEP, BEFORE = ("email", "ip", "card", "phone"), 0.5, 40
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def luhn(d: str) -> str:
    """SQL: whether a string of digits passes Luhn."""
    v = f"cast(substring({d}, length({d}) - i + 1, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 0, 2 * {v} - if({v} > 4, 9, 0), {v})) % 10 = 0"


def mod97(m: str) -> str:
    c = f"replace({m}, ' ', '')"
    turned = f"concat(substring({c}, 5), substring({c}, 1, 4))"
    return f"aggregate(split({turned}, ''), 0L, (s, c) -> if(c = '', s, if(c rlike '[0-9]', (s * 10 + cast(c as long)) % 97, (s * 100 + ascii(c) - 55) % 97))) = 1"


def confirmed(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return {
        "ip": f"{m} rlike {quoted(f'^{OCTET}(?:[.]{OCTET}){{3}}$')}",
        "card": f"length({m}) between 16 and 37 and length({digits}) between 16 and 19 and {luhn(digits)}",
        "phone": f"length({digits}) between 8 and 15",
        "iban": mod97(m),
        "secret": f"not {m} rlike '^[0-9]+$'",
    }.get(kind, "true")


CHUNK, LEVELS, CUT = 64, 3, 1024


def let(value: str, name: str, body: str) -> str:
    """SQL for body with a name for value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def before(a: str, total: Callable[[str], str], one: Callable[[str, str], str], level: int = LEVELS) -> str:
    """SQL for what lies before each element of array `a`: total(array) of the elements ahead, joined by one(x, y).

    Chunks are summed first, then what lies before each chunk, so that no element looks at more than CHUNK others.
    """
    ahead = lambda xs, i: total(f"slice({xs}, 1, {i})")
    if not level:
        return f"transform({a}, (x, i) -> {ahead(a, 'i')})"
    c, t, o = f"c{level}", f"t{level}", f"o{level}"
    chunks = f"transform(sequence(0, greatest(size({a}) - 1, 0) div {CHUNK}), i -> slice({a}, cast(i as int) * {CHUNK} + 1, {CHUNK}))"
    inside = f"flatten(transform({c}, (ch, k) -> transform(ch, (x, i) -> {one(f'{o}[k]', ahead('ch', 'i'))})))"
    return let(chunks, c, let(f"transform({c}, ch -> {total('ch')})", t, let(before(t, total, one, level - 1), o, inside)))


def sums(a: str) -> str:
    return before(a, lambda xs: f"aggregate({xs}, 0, (s, y) -> s + y)", lambda x, y: f"{x} + {y}")


def tops(a: str) -> str:
    return before(a, lambda xs: f"aggregate({xs}, 0, (s, y) -> greatest(s, y))", lambda x, y: f"greatest({x}, {y})")


def spans_of(kind: str, pattern: str, must: str | None) -> str:
    """SQL for the confirmed and scored spans of one kind."""
    q, item = quoted(pattern), "array<struct<start: int, end: int, m: string, near: string>>"
    # pieces and matches in turns; a match may follow within the context of others, each at least two characters long
    back = BEFORE // 2 + 1
    near = f"right(concat(array_join(transform(sequence(greatest(i - {back}, 0), i), j -> concat(if(j = greatest(i - {back}, 0), '', z.m[j - 1]), tail[j])), '')), {BEFORE})"
    found = f"transform(z.m, (x, i) -> named_struct('start', at[i] + length(z.p[i]), 'end', at[i] + length(z.p[i]) + length(x), 'm', x, 'near', lower({near})))"
    lengths = "transform(z.m, (x, i) -> length(z.p[i]) + length(x))"
    searched = let(
        f"named_struct('p', split(__t, {q}, -1), 'm', regexp_extract_all(__t, {q}, 0))", "z",
        let(f"transform(z.p, x -> right(x, {BEFORE}))", "tail", let(lengths, "own", let(sums("own"), "at", f"cast({found} as {item})"))),
    )
    needs = f"contains(__t, '{must}')" if must else f"regexp_like(__t, {q})"
    kept = f"filter(if({needs}, {searched}, cast(array() as {item})), x -> {confirmed(kind, 'x.m')})"
    plain = f"if(x.m rlike '{KEYS}', 0.6D, {SCORES[kind]}D)" if kind == "secret" else f"{SCORES[kind]}D"
    score = f"{plain} + if(x.near rlike '{CONTEXT[kind]}', 0.4D, 0D) - if(x.near rlike '{AGAINST[kind]}', 0.4D, 0D)"
    return f"transform({kept}, x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.end, 'score', round({score}, 1)))"


def with_spans(docs: DataFrame, text: str = "text", keep: float = KEEP) -> DataFrame:
    """Add `spans`, an array of (kind, start, end, score) by kind, then start.

    Null text has none. Kinds email, ip, card and phone stay whatever they score; iban, ssn and secret need
    `keep`. Kinds may overlap each other, matches of one kind do not. A column named spans is replaced.
    """
    plain = docs.drop("spans")
    body = plain.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    for p in PATTERNS:
        body = body.withColumn(f"__{p[0]}", F.expr(spans_of(*p)))
    every = F.concat(*(F.col(f"__{k}") if k in BASE else F.filter(F.col(f"__{k}"), lambda x: x["score"] >= keep) for k, _, _ in PATTERNS))
    return body.withColumn("spans", every).drop("__t", *(f"__{k}" for k, _, _ in PATTERNS))


def masked(docs: DataFrame) -> DataFrame:
    """docs with `spans`: text with every span replaced by its kind in brackets; overlapping spans become one, named for the first.

    The text is cut into chunks once, so that what lies between two spans is found without reading all before it.
    """
    ordered = "array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    piece = lambda a, b: f"substring(array_join(slice(parts, {a} div {CUT} + 1, greatest({b} - 1, {a}) div {CUT} - {a} div {CUT} + 1), ''), {a} % {CUT} + 1, {b} - {a})"
    each = f"transform(ss, (s, i) -> if(s.start >= top[i], concat({piece('top[i]', 's.start')}, '[', upper(s.kind), ']'), ''))"
    rest = f"{piece('last', 'n')}"
    sql = let(
        f"regexp_extract_all(text, '(?s).{{1,{CUT}}}', 0)", "parts",
        let(ordered, "ss", let("transform(ss, s -> s.end)", "ends", let(tops("ends"), "top", let("array_max(ends)", "last", let("length(text)", "n", f"concat(array_join({each}, ''), if(last < n, {rest}, ''))"))))),
    )
    return docs.withColumn("text", F.when(F.size("spans") > 0, F.expr(sql)).otherwise(F.col("text")))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents: doc_id, counts and digest of the base kinds, all spans. Edge cases as in with_spans."""
    docs = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return docs.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
