"""Personal data by DataFrame functions alone: patterns propose spans, validators (Luhn, mod 97,
number ranges) confirm them, and nearby context words adjust a score.

Positions come from splitting a text at a pattern's matches: a span starts after the gaps and
matches before it. Patterns use possessive and look-around forms that match exactly what the
plain pattern does (noted at each), but run in linear time and constant stack on any text.

Kinds `email ip card phone` are reported whenever their validator holds; the score is told. The
further kinds `iban` and `national_id` must also reach `MIN_SCORE`.

Defined results: null texts have no spans; repeated rows and null ids are judged each for itself;
other columns are untouched (result columns get fresh names); an empty table gives an empty one. Very long texts
are judged whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MIN_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.35

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double,value:string>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str                      # Java form of the documented pattern
    hint: str | None = None           # texts without it have no match (a literal)
    base: float = 0.6
    words: tuple[str, ...] = field(default=())   # context words, lower case
    always: bool = False              # reported whatever the score


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    d = F.transform(F.split(F.reverse(number), ""), lambda x, i: F.when(
        i % 2 == 1, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (no blanks) has remainder 1 after its head is moved to the end."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, x: F.when(
        x == "", a).when(x.rlike("^[0-9]$"), (a * 10 + x.cast("int")) % 97).otherwise(
            (a * 100 + F.ascii(x) - 55) % 97)) == 1


#: Each pattern is followed in KINDS by its documented form, of which it is an equal.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : a run of local characters is tried from its
    # start (or from the end of the match before) only, since a later start in it can't do better
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", 0.9, ("mail", "email", "contact", "write"), True),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) : from the start of a run of digits
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.7, ("ip", "address", "host", "server"), True),
    # [0-9]([\x20-]?[0-9])+ : maximal chains; only those of 16 to 19 digits
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", None, 0.8,
         ("card", "visa", "credit", "payment"), True),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, ("phone", "tel", "call", "mobile", "fax"), True),
    # [A-Z][A-Z][0-9][0-9][A-Z0-9]+ : from the start of a run of letters and digits
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,30}(?![A-Za-z0-9])", None, 0.6,
         ("iban", "bank", "account", "konto")),
    # [0-9]{3}-[0-9]{2}-[0-9]{4} with no digit or dash beside it
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3,
         ("ssn", "social", "security", "tax id")),
)
BASE = tuple(k.name for k in KINDS if k.always)


def valid(kind: str, m: Column) -> Column:
    """Whether a proposed span of this kind is confirmed."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "national_id":
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return F.lit(True)


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, in order: about n log n steps for n matches."""
    pat = F.lit(kind.pattern)
    has = text.contains(kind.hint) if kind.hint else F.lit(True)
    none = F.array().cast(f"array<{SPAN}>")
    found = F.when(has, F.regexp_extract_all(text, pat, F.lit(0)))
    pieces = F.when(F.size(found) > 0, F.struct(found.alias("m"), F.split(text, kind.pattern, -1).alias("gap")))

    def spans(p: Column, starts: Column) -> Column:
        def one(i: Column) -> Column:
            m, before, after = p["m"][i], p["gap"][i], p["gap"][i + 1]
            near = F.lower(F.concat_ws(" ", F.substring(before, -CONTEXT_CHARS, CONTEXT_CHARS),
                                       F.substring(after, 1, CONTEXT_CHARS)))
            score = F.lit(kind.base) + F.when(near.rlike("|".join(kind.words)), CONTEXT_GAIN).otherwise(0.0)
            score = F.least(score, F.lit(1.0))
            span = F.struct(F.lit(kind.name).alias("kind"), starts[i].alias("start"), (starts[i] + F.length(m)).alias("end"),
                            score.alias("score"), m.alias("value")).cast(SPAN)
            ok = valid(kind.name, m) if kind.always else valid(kind.name, m) & (score >= MIN_SCORE)
            return F.when(ok, span)
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(p["m"]) - 1), one), lambda s: s.isNotNull())

    # transform over a one-element array binds a value, so that it is formed once
    bound = F.transform(F.array(pieces), lambda p: F.transform(F.array(_starts(p)), lambda s: spans(p, s))[0])
    return F.when(F.size(found) > 0, bound[0]).otherwise(none)


def _starts(p: Column) -> Column:
    """Where the matches start: running sums of what lies before them."""
    steps = F.transform(F.sequence(F.lit(0), F.size(p["m"]) - 1), lambda i: (
        F.length(p["gap"][i]) + F.coalesce(F.length(F.get(p["m"], i - 1)), F.lit(0))).cast("bigint"))
    return _running(steps, lambda x, y: x + F.coalesce(y, F.lit(0).cast("bigint")))


def _running(values: Column, combine) -> Column:
    """Running results of an associative `combine(value, earlier one or null)` over a non-empty array, by doubling: no array
    grows entry by entry."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int"))
    return F.aggregate(rounds, values, lambda acc, k: F.transform(
        acc, lambda x, i: combine(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)))))


def find_spans(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> tuple[DataFrame, str]:
    """`docs` with an array of spans (kind, start, end in code points, score, value), ordered by kind as
    listed, then start; returned with that column's name."""
    out = fresh(docs, "pii")
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.concat(*[_spans(t, k) for k in kinds])), out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """`docs` with every span of the text replaced by its kind in brackets. Overlapping spans become one,
    named after the first (of those, the longest); null texts stay null."""
    flagged, out = find_spans(docs, text, kinds)
    t = F.col(text)
    ordered = F.array_sort(F.transform(out, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("less"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(s: Column, reach: Column) -> Column:
        # reach[i]: where the spans up to i end; a span that begins there or later begins a new cut
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0).cast("bigint"))
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: s[i]["start"] >= before(i))
        return F.concat(F.array_join(F.transform(firsts, lambda i: F.concat(
            F.substr(t, before(i).cast("int") + 1, (s[i]["start"] - before(i)).cast("int")),
            F.lit("["), F.upper(s[i]["kind"]), F.lit("]"))), ""),
            F.substr(t, F.element_at(reach, -1).cast("int") + 1))

    new = F.transform(F.array(ordered), lambda s: F.transform(F.array(_running(
        F.transform(s, lambda x: x["end"]), F.greatest)), lambda reach: cut(s, reach))[0])[0]
    return flagged.withColumn(text, F.when(F.size(out) > 0, new).otherwise(t)).select(*docs.columns)


def _count(kind: str) -> Column:
    return F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("bigint")


def query(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans."""
    flagged, out = find_spans(docs.select("doc_id", "text"))
    spans = flagged.select("doc_id", F.col(out).alias("s"))
    base = F.filter("s", lambda s: s["kind"].isin(*BASE))
    return spans.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def _sql_kind(i: int, kind: str, pattern: str, ok: str) -> str:
    return f"""
k{i} AS (SELECT r, {i} AS k, '{kind}' AS kind, m, a + g + lag_m AS s FROM (SELECT r, m, gi AS g, a, lag_m FROM (
    SELECT r, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: 0)) AS a,
    unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) AS BIGINT))) AS gi,
    unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS lag_m
    FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM d))) WHERE {ok})"""


_LUHN = ("list_sum(list_transform(range(1, len(dd) + 1), lambda i: CASE WHEN i % 2 = 0 THEN "
         "CAST(dd[i] AS INT) * 2 - CASE WHEN CAST(dd[i] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(dd[i] AS INT) END)) % 10 = 0")
_MOD97 = ("list_reduce(list_prepend(0, list_transform(string_split(m[5:] || m[:4], ''), lambda x: "
          "CASE WHEN x >= '0' AND x <= '9' THEN CAST(ascii(x) - 48 AS INT) ELSE ascii(x) - 55 END)), lambda a, x: "
          "CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1")
_DIG = "regexp_replace(m, '[^0-9]', '', 'g')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_sql_kind(1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'TRUE')},
{_sql_kind(2, 'ip', '[0-9]+(?:[.][0-9]+){3}', "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255")},
{_sql_kind(3, 'card', '[0-9](?:[ -]?[0-9])+', f"length({_DIG}) BETWEEN 16 AND 19")},
{_sql_kind(4, 'phone', '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIG}) BETWEEN 8 AND 15")},
{_sql_kind(5, 'iban', '[A-Za-z0-9]+', "regexp_full_match(m, '[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,30}') AND " + _MOD97)},
c AS (SELECT * EXCLUDE dd FROM (SELECT *, string_split(reverse({_DIG}), '') AS dd FROM k3) WHERE {_LUHN}),
al AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM c UNION ALL SELECT * FROM k4 UNION ALL SELECT * FROM k5),
p AS (SELECT r, sum((k = 1)::INT) AS n1, sum((k = 2)::INT) AS n2, sum((k = 3)::INT) AS n3, sum((k = 4)::INT) AS n4,
    string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY k, s) AS spans,
    string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY k, s) FILTER (WHERE k <= 4) AS base FROM al GROUP BY r)
SELECT doc_id, CAST(coalesce(n1, 0) AS BIGINT) AS n_email, CAST(coalesce(n2, 0) AS BIGINT) AS n_ip,
    CAST(coalesce(n3, 0) AS BIGINT) AS n_card, CAST(coalesce(n4, 0) AS BIGINT) AS n_phone,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN p USING (r)
"""
